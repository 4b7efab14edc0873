"""Evaluation passages inside training text (problem 7).

A positional inverted index is made of the training text: for each three-word term that occurs in an evaluation item,
the documents and word positions that hold it. Documents that hold three neighbouring terms of an item in a row (five
words) are looked at, since every passage with its changes holds such a stretch. Their full
lists are intersected by offset (position in the document less position in the item): equal offsets are exact
phrases, offsets that differ by a word or two nearby are phrases with a word changed, added or dropped. A posting also
names the pairs of words around its term, so that two words beyond a change at a passage's end count as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from phylospan.session import materialise

TERM_WORDS = 3
MIN_WORDS = 15
#: Words of the items of a block, which bounds all that is broadcast: about 100 bytes a word.
BLOCK_WORDS = 500_000
NEAR_WORDS = 8
#: At most one word in so many of a passage may be changed, added or dropped. Several neighbouring words count one more.
WORDS_PER_CHANGE = 7
#: With one change in seven words at most, a passage of fifteen words or more holds a stretch of five unchanged ones.
STRETCH_TERMS = 3
#: Runs with at most so many words between them are joined.
REACH_WORDS = 5
RUN_COLUMNS = ("first", "last", "off", "lost", "ahead", "behind")

#: Tags, the target of a piped link and the name of an inline template: they stand between words, not for words.
MARKUP = r"</?[a-z][^<>]*>|\[\[[^\[\]|]*\||\{\{[a-z]+\||&[a-z0-9#]{1,8};"


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text in reading order, without case, accents, markup, punctuation and invisible characters."""
    t = pc.utf8_lower(pc.utf8_normalize(pc.fill_null(texts, ""), "NFKD"))
    t = pc.replace_substring_regex(t, MARKUP, " ")
    t = pc.replace_substring_regex(t, r"[\p{Cf}\p{Mn}]+", "")
    t = pc.utf8_trim(pc.replace_substring_regex(t, r"[^\p{L}\p{N}]+", " "), " ")
    return pc.split_pattern(t, " ")


class TermIndex:
    """The terms of a block of items: the number of each word, and the sorted keys of pairs of words and of terms.

    A key is a number of at most (words + 1)^2, or pairs times words, which 64 bits hold for any block of under two
    thousand million words.
    """

    def __init__(self, item_words: list[list[str]]):
        self.word = {w: k for k, w in enumerate(sorted({w for words in item_words for w in words}))}
        self.base = len(self.word) + 1
        coded = [self.code(words) for words in item_words]
        joined = lambda parts: np.unique(np.concatenate([*parts, np.empty(0, np.int64)]))
        self.pairs = joined([c[:-1] * self.base + c[1:] for c in coded])
        keys = joined([self.keys(c) for c in coded])
        self.sorted = keys[keys >= 0]

    def code(self, words: list[str]) -> np.ndarray:
        return np.array([self.word[w] for w in words], np.int64)

    def pair_numbers(self, coded: np.ndarray) -> np.ndarray:
        """The number of the pair of words that begins at each word; -1 where no item has it."""
        a, b = coded[:-1], coded[1:]
        return _place(self.pairs, np.where((a < 0) | (b < 0), -1, a * self.base + b))

    def keys(self, coded: np.ndarray) -> np.ndarray:
        """The key of the term that begins at each word; -1 where two neighbouring words are in no item."""
        return self.keys_of(self.pair_numbers(coded), coded)

    def keys_of(self, pair: np.ndarray, coded: np.ndarray) -> np.ndarray:
        return np.where((pair[:-1] < 0) | (coded[2:] < 0), -1, pair[:-1] * self.base + coded[2:]) if len(coded) >= TERM_WORDS else np.empty(0, np.int64)

    def around(self, pair: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms that begin at the words `at`: the numbers of the pairs three and two words before, and three and four after, as one number each.

        `text` tells the words' texts apart; a pair that isn't wholly in the term's text is -1.
        """

        def number(step: int) -> np.ndarray:
            inside = (at + step >= 0) & (at + step < len(pair))
            place = np.where(inside, at + step, 0)
            same = inside & (text[place] == text[at]) & (text[np.minimum(place + 1, len(text) - 1)] == text[at])
            return np.where(same, pair[place], -1) + 1

        return (number(-3) << 32) + number(-2), (number(3) << 32) + number(4)

    def stretches(self, terms: np.ndarray) -> np.ndarray:
        """The key of the stretch that begins at each term: its first and last term share a word and so name all five words."""
        return terms[: -(STRETCH_TERMS - 1)].astype(np.int64) * len(self.sorted) + terms[STRETCH_TERMS - 1 :]

    def terms(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's term, -1 where no item has it."""
        return _place(self.sorted, keys)


def _place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _near_runs(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True for postings in a stretch of three neighbouring ones (five words), or within a few words of one.

    A passage of fifteen words with two changed words holds such a stretch, so nothing that counts is left out.
    """
    if not len(pos):
        return np.empty(0, bool)
    first = np.concatenate(([True], (np.diff(pos) != 1) | (np.diff(doc) != 0)))
    begin = np.flatnonzero(first)
    length = np.diff(np.concatenate((begin, [len(pos)])))
    core = np.repeat(length >= 3, length)
    if not core.any():
        return core
    spread = pos + doc * (1 << 32)
    place = spread[core]
    at = np.searchsorted(place, spread)
    before, after = place[np.maximum(at - 1, 0)], place[np.minimum(at, len(place) - 1)]
    return np.minimum(np.abs(spread - before), np.abs(after - spread)) <= NEAR_WORDS


def _postings(index):
    schema = pa.schema([("term", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("stretch", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: TermIndex = index.value
        for batch in batches:
            words = words_of(batch.column(1))
            offsets = words.offsets.to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            number = np.array([terms.word.get(w, -1) for w in coded.dictionary.to_pylist()] or [-1], np.int64)
            flat = number[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
            offsets -= offsets[0]
            doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
            pair = terms.pair_numbers(flat)
            term = terms.terms(terms.keys_of(pair, flat))
            where = np.flatnonzero(term >= 0)
            where = where[doc[where] == doc[where + TERM_WORDS - 1]]
            pos = where - offsets[doc[where]]
            keep = _near_runs(doc[where], pos)
            where, pos = where[keep], pos[keep]
            stretch = np.full(len(where), -1, np.int64)
            if len(where) >= STRETCH_TERMS:
                whole = (where[STRETCH_TERMS - 1 :] - where[: -(STRETCH_TERMS - 1)] == STRETCH_TERMS - 1) & (doc[where[STRETCH_TERMS - 1 :]] == doc[where[: -(STRETCH_TERMS - 1)]])
                stretch[: -(STRETCH_TERMS - 1)] = np.where(whole, terms.stretches(term[where]), -1)
            ids = batch.column(0).cast(pa.int64()).take(pa.array(doc[where]))
            before, after = terms.around(pair, doc, where)
            yield pa.RecordBatch.from_arrays([pa.array(term[where], pa.int32()), ids, pa.array(pos, pa.int32()), pa.array(stretch), pa.array(before), pa.array(after)], schema=schema)

    return run


def _is_passage(runs: Iterable[tuple[int, int, int, int, int, int]]) -> bool:
    """Whether runs (first, last, off, lost, ahead, behind) by first and last word, joined where their offsets drift by a word or two, make up a passage."""
    ends: list[tuple[int, int, int, int]] = []  # (doc end, item end, item start, words lost)
    for first, last, offset, lost, ahead, behind in runs:
        # Runs come by their first word, so an end that is too far before this one is so for all that follow.
        ends = [e for e in ends if first - e[0] - 1 <= REACH_WORDS]
        options = {lost: first - offset}  # the smallest item start for each number of lost words
        if ahead:
            options[lost + 1] = first - offset - ahead
        for doc_end, item_end, item_start, before in ends:
            in_doc, in_item = first - doc_end - 1, first - offset - item_end - 1
            if -3 <= min(in_doc, in_item) and max(in_doc, in_item) <= REACH_WORDS and abs(in_doc - in_item) <= 2 and last > doc_end and last - offset > item_end:
                between = max(in_doc, in_item, abs(in_doc - in_item), 1)
                total = before + lost + between + (between > 1)
                options[total] = min(item_start, options.get(total, item_start))
        reached = first - offset + 1
        for total in sorted(options):
            length = last - offset - options[total] + 1
            for length, changes in ((length, total), (length + behind, total + (behind > 0))):
                if length >= MIN_WORDS and changes * WORDS_PER_CHANGE <= length:
                    return True
            # A chain that lost more words is kept only if it is longer.
            if options[total] < reached:
                reached = options[total]
                ends.append((last, last - offset, options[total], total))
    return False


@F.arrow_udf(BooleanType())
def _leaks(runs: pa.Array) -> pa.Array:
    """Whether a pair's runs make up a passage.

    Runs beyond each other's reach can't be joined, so each cluster of runs within reach is judged apart: single runs by
    array arithmetic, others one by one if they cover enough words of the document. Of fifteen words at most two are
    changed, so thirteen are covered; two words beyond a change at an end take up to three words and one change off.
    """
    runs = pa.array(runs) if isinstance(runs, pd.Series) else runs
    sizes, parts = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False), runs.flatten()
    leaks = np.zeros(len(runs), bool)
    if not len(parts):
        return pa.array(leaks)
    there = {f.name for f in parts.type}
    columns = [parts.field(name).to_numpy(zero_copy_only=False).astype(np.int64) if name in there else np.zeros(len(parts), np.int64) for name in RUN_COLUMNS]
    pair = np.repeat(np.arange(len(runs)), sizes)
    order = np.lexsort((columns[1], columns[0], pair))
    pair, columns = pair[order], [c[order] for c in columns]
    first, last, _, lost, ahead, behind = columns
    covered = np.maximum.accumulate((pair << 32) + last)  # the farthest word so far, in the pair
    begin = np.flatnonzero(np.concatenate(([True], (first + (pair << 32))[1:] - covered[:-1] - 1 > REACH_WORDS)))
    end = np.concatenate((begin[1:], [len(first)]))
    pair = pair[begin]
    words = np.maximum.reduceat(last, begin) - first[begin] + 1
    ahead, behind = np.maximum.reduceat(ahead, begin), np.maximum.reduceat(behind, begin)
    single = end - begin == 1
    for a, b in ((0, 0), (ahead, 0), (0, behind), (ahead, behind)):
        length, changes = words + a + b, lost[begin] + np.minimum(a, 1) + np.minimum(b, 1)
        leaks[pair[single & (length >= MIN_WORDS) & (changes * WORDS_PER_CHANGE <= length)]] = True
    least = MIN_WORDS - MIN_WORDS // WORDS_PER_CHANGE - 2 * np.minimum(ahead, 1) - 2 * np.minimum(behind, 1)
    for k in np.flatnonzero(~single & (words >= least)):
        if not leaks[pair[k]]:
            leaks[pair[k]] = _is_passage(zip(*(c[begin[k] : end[k]].tolist() for c in columns)))
    return pa.array(leaks)


def _item_terms(index):
    """(item_id, item_pos, term, stretch, item_before, item_after) of every term of the items; the stretch that begins at it, -1 at an item's end."""
    schema = pa.schema([("item_id", pa.int64()), ("item_pos", pa.int32()), ("term", pa.int32()), ("stretch", pa.int64()), ("item_before", pa.int64()), ("item_after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: TermIndex = index.value
        for batch in batches:
            for item_id, words in zip(batch.column(0).to_pylist(), words_of(batch.column(1)).to_pylist()):
                coded = table.code(words) if len(words) >= MIN_WORDS else np.empty(0, np.int64)
                pair = table.pair_numbers(coded)
                terms = table.terms(table.keys_of(pair, coded))
                stretch = np.full(len(terms), -1, np.int64)
                if len(terms) >= STRETCH_TERMS:
                    stretch[: -(STRETCH_TERMS - 1)] = table.stretches(terms)
                columns = [np.full(len(terms), item_id), np.arange(len(terms)), terms, stretch, *table.around(pair, np.zeros(len(coded)), np.arange(len(terms)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _beyond(found: Column, wanted: Column, ahead: bool) -> Column:
    """Words of the item that one change at a run's end and the two equal words beyond it make up; 0 if these aren't equal."""
    upper, lower = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))
    far, near = (upper, lower) if ahead else (lower, upper)
    equal = lambda a, b: (a > 0) & (a == b)
    # A word changed, dropped, or added in the document.
    return F.when(equal(far(found), far(wanted)) | equal(near(found), far(wanted)), 3).when(equal(far(found), near(wanted)), 2).otherwise(0)


def _find(spark: SparkSession, documents: DataFrame, items: DataFrame, words: list[list[str]]) -> DataFrame:
    """Leaks of one block of items (item_id, text), whose words are given."""
    index = TermIndex(words)
    shared = spark.sparkContext.broadcast(index)
    # A row a word of the block: small by the block's bound, unless a single item is longer than it.
    small = F.broadcast if sum(map(len, words)) <= 2 * BLOCK_WORDS else lambda df: df
    terms = items.mapInArrow(_item_terms(shared), "item_id bigint, item_pos int, term int, stretch bigint, item_before bigint, item_after bigint")
    item_terms, item_stretches = small(terms.drop("stretch")), small(terms.where("stretch >= 0").select("item_id", "stretch").distinct())
    postings = materialise(documents.mapInArrow(_postings(shared), "term int, doc_id bigint, pos int, stretch bigint, before bigint, after bigint"))
    pairs = postings.where("stretch >= 0").join(item_stretches, "stretch").select("doc_id", "item_id").distinct()
    postings = postings.drop("stretch").repartition("doc_id")
    hits = (
        postings.join(pairs, "doc_id").join(item_terms, ["item_id", "term"])
        .select("doc_id", "item_id", "pos", (F.col("pos") - F.col("item_pos")).alias("off"), _beyond(F.col("before"), F.col("item_before"), True).alias("ahead"), _beyond(F.col("after"), F.col("item_after"), False).alias("behind"))
    )
    along = Window.partitionBy("doc_id", "item_id", "off").orderBy("pos")
    step = F.col("pos") - F.lag("pos").over(along)
    # On one offset, a changed word takes three terms away: the next one is four further on.
    hits = hits.withColumn("step", step).withColumn("run", F.sum(F.when(F.col("step") <= TERM_WORDS + 1, 0).otherwise(1)).over(along))
    runs = hits.groupBy("doc_id", "item_id", "off", "run").agg(
        F.min("pos").alias("first"), (F.max("pos") + (TERM_WORDS - 1)).alias("last"), F.sum(F.when(F.col("step").between(2, TERM_WORDS + 1), 1).otherwise(0)).alias("lost"),
        F.min_by("ahead", "pos").alias("ahead"), F.max_by("behind", "pos").alias("behind"),
    )
    grouped = runs.groupBy("doc_id", "item_id").agg(
        F.collect_list(F.struct(*RUN_COLUMNS)).alias("runs"), F.sum(F.col("last") - F.col("first") + 1).alias("words")
    )
    return grouped.where(F.col("words") >= MIN_WORDS - 6).where(_leaks("runs")).select("doc_id", "item_id")


def find_leaks(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): the documents that hold a passage of at least 15 words of an item, in order and together.

    Case, accents, punctuation, markup, line ends, entities and invisible characters don't matter; hidden comments are
    text. Of a passage, one word in seven may be changed, added or dropped; beyond the outermost of them there must be two
    unchanged words, as a single one may be equal by chance. Null and empty texts hold nothing; items under
    15 words can't leak; rows with the same id count as one document. The items are the query set: they are taken in
    blocks of about `block_words` words, each block's terms being broadcast; every block is held against all documents.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("item_id").isNotNull() & (F.length("text") > 0)).dropDuplicates(["item_id"])
    # White space and signs bound the number of words from above.
    size = wanted.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    found = None
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        # Only the words of a block's items come to the driver.
        texts_of = pa.array([r["text"] for r in part.select("text").collect()], pa.string())
        words = [w for w in words_of(texts_of).to_pylist() if len(w) >= MIN_WORDS]
        one = _find(spark, texts, part, words)
        found = one if found is None else found.unionByName(one)
    return found
