"""Mapping of freely typed names to a canonical list (problem 2).

Only the distinct typed values are resolved. A symmetric-delete dictionary of the list, hashed keys in sorted arrays, is
broadcast in blocks of a bounded number of names: names and values that are within the edit bound share a key made by deleting that many
letters from their first letters. The few candidates are ranked by a weighted Damerau-Levenshtein cost, then by how
often the list's name occurs in the data. Values without a candidate come out with id 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospan.functions.text import NULL_WORDS
from phylospan.session import materialise

MAX_EDITS = 3
WORD_EDITS = 2
PREFIX = 11
#: Names of a block. A name has up to 366 keys of 12 bytes, so a block is 44 MB at most beside its names.
BLOCK_NAMES = 10_000

# Letters of other scripts that look like a Latin one, and pairs that scanning confuses.
LOOKALIKES = dict(zip("асеорхуіѕһԁԛԝɡѵјκονατιρυ", "aceopxyishdqwgvjkovatipu"))
CONFUSED = {frozenset(x) for x in ("il", "uv", "ec", "oc", "vw", "nh", "bh", "gq", "ij", "rt", "ft", "mn", "ao", "ae", "eo", "iu")}
# Leading words that say nothing about which taxon is meant.
DECORATION = re.compile(r"^(?:candidatus|ca\.|[dpcofgs]__)\s*")


def fold(value: str) -> str:
    """Lower case Latin letters without accents; look-alike letters become the Latin one; separators become spaces."""
    text = unicodedata.normalize("NFKD", value)
    text = "".join(LOOKALIKES.get(c, c) for c in text.lower() if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = re.sub(r"['\"`´‘’“”]", "", text)
    return re.sub(r"[\s_]+", " ", text).strip()


@cache
def _kept(length: int, edits: int) -> np.ndarray:
    """The places that stay when up to `edits` of `length` letters are deleted, a row a choice, filled up with `length`."""
    rows = [c for n in range(max(0, length - edits), length + 1) for c in combinations(range(length), n)]
    out = np.full((len(rows), max(1, length)), length, np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 40)], np.uint64)


def delete_keys(word: str, edits: int, prefix: int = PREFIX) -> np.ndarray:
    """The keys of a word: hashes of its first letters with up to `edits` of them deleted. Equal letters give equal keys;
    a chance collision only adds a candidate, whose distance is looked at."""
    head = word[:prefix]
    codes = np.array([*(ord(c) + 1 for c in head), 0], np.uint64)
    kept = _kept(len(head), edits)
    keys = (codes[kept] * _POWERS[: kept.shape[1]]).sum(axis=1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(29))


def deletes(word: str, edits: int, prefix: int = PREFIX) -> set[int]:
    """The keys of a word as a set."""
    return set(delete_keys(word, edits, prefix).tolist())


def letter_counts(word: str) -> np.ndarray:
    """How often each of a-z occurs in a word."""
    codes = np.frombuffer(word.encode("ascii", "ignore"), np.uint8) - 97
    return np.bincount(codes[codes < 26], minlength=26).astype(np.int16)


class DeleteTable:
    """From delete keys to entries: two arrays sorted by key."""

    def __init__(self, words: list[str], edits: int):
        keys = [delete_keys(w, edits) if w else np.empty(0, np.uint64) for w in words]
        entry = np.repeat(np.arange(len(words), dtype=np.int32), [len(k) for k in keys])
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.entries, self.edits = flat[order], entry[order], edits
        self.letters = np.array([letter_counts(w) for w in words], np.int16).reshape(-1, 26)

    def near(self, word: str) -> list[int]:
        """Entries that share a key and whose letters differ by no more than the edits can change."""
        wanted = np.unique(delete_keys(word, self.edits))
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        hit = high > low
        if not hit.any():
            return []
        near = np.unique(np.concatenate([self.entries[a:b] for a, b in zip(low[hit], high[hit])]))
        return near[np.abs(self.letters[near] - letter_counts(word)).sum(axis=1) <= 2 * self.edits].tolist()


def weighted_distance(a: str, b: str, bound: float) -> tuple[float, int]:
    """(weighted cost, edits) of turning a into b by insertions, deletions, substitutions and swaps of neighbours.

    A doubled letter costs 0.5, letters that are easily confused 0.6, a swap 0.8, m for rn 0.6 (two edits), others 1.
    (inf, 99) when the bound is passed.
    """
    if abs(len(a) - len(b)) > bound * 2:
        return float("inf"), 99
    width = int(bound * 2) + 1
    far = (float("inf"), 99)
    rows: list[list[tuple[float, int]]] = [[(float(j), j) for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= width:
            row[0] = (float(i), i)
        least = row[0][0]
        for j in range(max(1, i - width), min(len(b), i + width) + 1):
            x, y = a[i - 1], b[j - 1]
            up, left, across = rows[i - 1][j], row[j - 1], rows[i - 1][j - 1]
            best = across if x == y else (across[0] + (0.6 if frozenset((x, y)) in CONFUSED else 1.0), across[1] + 1)
            cost = 0.5 if i > 1 and a[i - 2] == x else 1.0
            best = min(best, (up[0] + cost, up[1] + 1))
            cost = 0.5 if j > 1 and b[j - 2] == y else 1.0
            best = min(best, (left[0] + cost, left[1] + 1))
            if i > 1 and j > 1:
                if x == b[j - 2] and a[i - 2] == y and x != y:
                    best = min(best, (rows[i - 2][j - 2][0] + 0.8, rows[i - 2][j - 2][1] + 1))
            if i > 1 and a[i - 2 : i] == "rn" and y == "m":
                best = min(best, (rows[i - 2][j - 1][0] + 0.6, rows[i - 2][j - 1][1] + 2))
            if j > 1 and b[j - 2 : j] == "rn" and x == "m":
                best = min(best, (rows[i - 1][j - 2][0] + 0.6, rows[i - 1][j - 2][1] + 2))
            row[j] = best
            least = min(least, best[0])
        if least > bound:
            return far
        rows.append(row)
    return rows[-1][-1]


class Dictionary:
    """The symmetric-delete dictionary of a block of names: (name, id, frequency)."""

    def __init__(self, names: list[tuple[str, int, int]]):
        self.names = []
        self.exact: dict[str, tuple[float, int, int]] = {}
        for name, species_id, frequency in names:
            words = re.findall(r"[a-z]+", fold(name))
            if not words:
                continue
            same = (0.0, -frequency, species_id)
            self.exact["".join(words)] = min(same, self.exact.get("".join(words), same))
            self.names.append((words[0], words[1] if len(words) > 1 else "", "".join(words), species_id, frequency))
        self.genus, self.epithet, self.whole = (DeleteTable([n[k] for n in self.names], edits) for k, edits in ((0, WORD_EDITS), (1, WORD_EDITS), (2, MAX_EDITS)))

    def lookup(self, value: str) -> tuple[float, int, int] | None:
        """(cost, -frequency, id) of the best entry within the bound, or None."""
        text = DECORATION.sub("", fold(value))
        swapped = re.match(r"^([a-z.\-]+)\s*,\s*([a-z.\-]+)(.*)$", text)
        texts = [text] + ([f"{swapped[2]} {swapped[1]}{swapped[3]}"] if swapped else [])
        best: list[tuple[float, int, int]] = []
        for form in texts:
            words = re.findall(r"[a-z]+\.?", re.sub(r"(?<=[a-z])[-­](?=[a-z])", "", form))
            plain = [w.rstrip(".") for w in words]
            whole = self.exact.get("".join(plain)) or self.exact.get("".join(plain[:2]))
            if whole:
                return whole
            for joined in {"".join(plain), "".join(plain[:2]), "".join(plain[:3]), plain[0] if plain and len(plain[0]) > 15 else ""}:
                for k in self.whole.near(joined) if len(joined) > 6 else ():
                    genus, epithet, whole, species_id, frequency = self.names[k]
                    cost, edits = weighted_distance(joined, whole, MAX_EDITS)
                    if edits <= MAX_EDITS and edits * 5 <= len(whole):
                        best.append((cost, -frequency, species_id))
            if len(words) >= 2 and (words[0].endswith(".") or words[1].endswith(".")):
                best += self._abbreviated(words[0], words[1])
        return min(best, default=None)

    def _abbreviated(self, first: str, second: str) -> Iterator[tuple[float, int, int]]:
        """Entries for a shortened genus ("Q. durolinatus") or epithet ("Klusispira turolinar.")."""
        short_genus, short_epithet = first.endswith("."), second.endswith(".")
        first, second = first.rstrip("."), second.rstrip(".")
        if short_genus and not short_epithet and len(second) > 4:
            for k in self.epithet.near(second):
                genus, epithet, _, species_id, frequency = self.names[k]
                cost, edits = weighted_distance(second, epithet, WORD_EDITS)
                if genus.startswith(first) and edits <= WORD_EDITS and edits * 4 <= len(epithet):
                    yield cost + 0.25, -frequency, species_id
        elif short_epithet and not short_genus and len(second) >= 3:
            for k in self.genus.near(first):
                genus, epithet, _, species_id, frequency = self.names[k]
                cost, edits = weighted_distance(first, genus, WORD_EDITS)
                tail, more = weighted_distance(second, epithet[: len(second)], 1)
                if edits <= WORD_EDITS and edits * 4 <= len(genus) and more <= 1 and more * 5 <= len(second):
                    yield cost + tail + 0.25, -frequency, species_id


def is_case(value: Column, names: DataFrame | None = None) -> Column:
    """True for a value that says something: not null, blank or a word for a missing label."""
    word = F.lower(F.trim(value))
    return value.isNotNull() & (word != "") & ~word.isin("unclassified", *NULL_WORDS)


def typed_values(rows: DataFrame, id_column: str, fields: list[str], species: DataFrame) -> DataFrame:
    """(id, field_name, value) of every typed value that isn't exactly a name of the list."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)))
    long = rows.select(F.col(id_column), pairs.alias("x")).select(id_column, "x.field_name", "x.value").where(is_case(F.col("value")))
    known = species.select(F.col("species_name").alias("value")).distinct()
    return long.join(known, "value", "left_anti")


def resolve_values(values: DataFrame, species: DataFrame, frequency: DataFrame | None = None, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(value, species_id) for the distinct strings of column `value`; 0 where no entry is within the bound.

    species: species_id, species_name, synonyms. frequency: (name, n), how often a name occurs as it is; equal costs go
    to the more frequent name, then to the smaller id. A list of more than `block_names` names is taken in blocks, each
    broadcast on its own, and the best over all blocks is kept.
    """
    names = species.select("species_id", F.explode(F.concat(F.array("species_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    names = names.where(F.trim("name") != "").groupBy("name").agg(F.min("species_id").alias("species_id"))
    blocks = max(1, -(-names.count() // block_names))
    if frequency is not None:
        names = names.join(frequency, "name", "left")
    else:
        names = names.withColumn("n", F.lit(0))
    names = names.select("name", "species_id", F.coalesce("n", F.lit(0)).alias("n"))
    # An explicit number of partitions: the strings are few bytes but costly, so they must not be coalesced into one task.
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select("value").where(F.col("value").isNotNull()).distinct().repartition(spread)
    if blocks > 1:
        # Read once a block; the data behind them are read once.
        names, distinct = materialise(names), materialise(distinct)
    context = values.sparkSession.sparkContext
    found: DataFrame | None = None
    for b in range(blocks):
        part = names if blocks == 1 else names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        # Built once a block and loaded once a worker process.
        dictionary = context.broadcast(Dictionary(sorted(tuple(x) for x in part.collect())))

        def run(batches: Iterator[pd.DataFrame], dictionary=dictionary) -> Iterator[pd.DataFrame]:
            lookup = dictionary.value.lookup
            for batch in batches:
                best = [lookup(v) for v in batch["value"]]
                yield pd.DataFrame({
                    "value": batch["value"],
                    "cost": [x[0] if x else float("inf") for x in best],
                    "rarity": [x[1] if x else 0 for x in best],
                    "species_id": [x[2] if x else 0 for x in best],
                })

        one = distinct.mapInPandas(run, "value string, cost double, rarity bigint, species_id bigint")
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("value").agg(F.min_by("species_id", F.struct("cost", "rarity", "species_id")).alias("species_id"))
    return found.select("value", "species_id")


def match_species(hits: DataFrame, species: DataFrame, id_column: str = "hit_id", fields: tuple[str, ...] = ("q_species", "t_species")) -> DataFrame:
    """(hit_id, field_name, species_id) of every typed value that isn't exactly a name of the list.

    0 reports a value that means no entry. Null and blank values and words for a missing label give no row; repeated
    rows stay; extra columns are ignored; an empty list gives 0 throughout.
    """
    long = typed_values(hits, id_column, list(fields), species)
    name_counts = (
        hits.select(F.explode(F.array(*(F.col(f) for f in fields))).alias("name")).where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    )
    resolved = resolve_values(long, species, name_counts)
    return long.join(resolved, "value").select(id_column, "field_name", "species_id")
