import base64
import random

import pytest
import tiktoken
from tokenizers import Tokenizer

from phylospan.llm import tokenise

JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def ranks():
    with open(tokenise.DEFAULT_VOCABULARY, "rb") as file:
        return tokenise.read_ranks(file.read())


def test_merge_word_agrees_with_library(ranks):
    public = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(1500):
        word = "".join(rng.choice("abcdeéß愛!?0😀 ") for _ in range(rng.choice((1, 3, 8, 30, 140))))
        want = public.encode_ordinary(word)
        assert tokenise.merge_word(word.encode(), ranks) == want == tokenise._merge_long(word.encode(), ranks)


def test_long_runs(ranks):
    for word in ("h" * 5000, "ab" * 3000, "!" * 4001):
        ids = tokenise.merge_word(word.encode(), ranks)
        inverse = {v: k for k, v in ranks.items()}
        assert b"".join(inverse[i] for i in ids) == word.encode()


def test_documents(spark):
    texts = [None, "", " ", "  \n\n x", "don't we'll 3.14 <|endoftext|>", "Café naïve\t\ttabs​ and spaces   x", "愛知 テスト тест δοκιμή مرحبا", "👨‍👩‍👧\r\nA\r", "a" * 3000, "x\u0085y 　z", "don't we'll 3.14 <|endoftext|>"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    public = Tokenizer.from_file(JSON)
    public.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in tokenise.encode_documents(df.repartition(3)).collect()}
    assert got == {k: public.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert got[0] == got[1] == [] and tokenise.encode_documents(df.where("false")).count() == 0


def test_corpus_round_trip(spark, sf_dir, ranks):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inverse = {v: k for k, v in ranks.items()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in tokenise.encode_documents(docs).collect():
        assert b"".join(inverse[i] for i in r.ids).decode() == texts[r.doc_id]


def test_ranks_file():
    assert tokenise.read_ranks(base64.b64encode(b"ab") + b" 7\n\n") == {b"ab": 7}
