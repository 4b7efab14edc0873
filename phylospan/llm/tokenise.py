"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

The JVM cuts each text into words by the vocabulary's pattern. Tasks dictionary-encode the words of an Arrow batch, so
that each distinct word is merged once; texts' ids are then gathered with array kernels. A word is merged with a
contiguous rank array: part boundaries and the ranks of adjacent parts, the minimum found by scanning.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHORT_WORD = 128  # bytes up to which the scan is used; longer runs use a heap with the same merge order
CACHE_WORDS = 500_000

# The word pattern of the vocabulary, with white space spelled as its Unicode property for the JVM.
_S = r"\p{IsWhite_Space}"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?![^{_S}])|{_S}+"

_NONE = 1 << 30
_vocabularies: dict[str, tuple[dict[bytes, int], dict[str, list[int]]]] = {}


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT_WORD:
        return _merge_long(word, ranks)
    bounds = list(range(len(word) + 1))
    pair = [ranks.get(word[k : k + 2], _NONE) for k in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == _NONE:
            break
        k = pair.index(low)
        del bounds[k + 1], pair[k]
        if k < len(pair):
            pair[k] = ranks.get(word[bounds[k] : bounds[k + 2]], _NONE)
        if k:
            pair[k - 1] = ranks.get(word[bounds[k - 1] : bounds[k + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge_word for long runs: the same order of merges (lowest rank, then leftmost) from a heap."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        if not live[k] or end[k] >= n or end[end[k]] != stop:
            continue
        other = end[k]
        live[other] = False
        end[k] = stop
        if stop < n:
            before[stop] = k
            if (r := ranks.get(word[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if (b := before[k]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def _vocabulary(key: int, content: bytes) -> tuple[dict[bytes, int], dict[str, list[int]]]:
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = (read_ranks(content), {})
    return _vocabularies[key]


def _encode_batches(content):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, cache = _vocabulary(content.id, content.value)
            words = batch.column(1)
            offsets = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            distinct, parts = coded.dictionary.to_pylist(), []
            for word in distinct:
                ids = cache.get(word)
                if ids is None:
                    ids = merge_word(word.encode(), ranks)
                    if len(cache) < CACHE_WORDS:
                        cache[word] = ids
                parts.append(ids)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            starts = np.concatenate(([0], np.cumsum(lengths)))
            flat = np.fromiter((x for ids in parts for x in ids), np.int32, int(starts[-1]))
            index = coded.indices.to_numpy()
            count = lengths[index]
            stops = np.cumsum(count)
            total = int(stops[-1]) if len(stops) else 0
            # position k of the output belongs to word w: its place in `flat` is starts[word] + (k - first output of w)
            shift = np.repeat(starts[index] - (stops - count), count)
            ids = flat[shift + np.arange(total)]
            ends = np.concatenate(([0], stops))[offsets - offsets[0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], schema=schema
            )

    return run


def encode_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every document; an empty list for an empty and for a null text.

    Strings of special tokens inside a text are ordinary text. Repeated rows stay. The vocabulary file (50 thousand
    tokens, under 1 MB) is read where the query is built and broadcast; executors need no copy of it.
    """
    with open(vocabulary, "rb") as file:
        raw = file.read()
    content = documents.sparkSession.sparkContext.broadcast(raw)
    words = documents.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN), F.lit(0)).alias("words")
    )
    return words.mapInArrow(_encode_batches(_Content(content, hashlib.sha256(raw).hexdigest())), "doc_id bigint, ids array<int>")


class _Content:
    """A broadcast with an id that tells vocabularies apart within a worker: the hash of their content."""

    def __init__(self, broadcast, digest: str):
        self.broadcast = broadcast
        self.id = digest

    @property
    def value(self) -> bytes:
        return self.broadcast.value
