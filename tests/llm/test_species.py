import pytest

from phylospan.llm import species

NAMES = [("Dincanedobacter vagolinensis", 1, 5), ("Dincanedobacter silariverinum", 2, 0), ("Klusospira turolinarum", 3, 9), ("Quentonema durolinatus", 4, 1), ("Grilvococcus gelamposa", 5, 0), ("Nullothrix turedinoides", 1, 0)]


@pytest.fixture(scope="module")
def dictionary():
    return species.Dictionary(NAMES)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("dincanedobacter VAGOLINENSIS", 1), ("'Dincanedobacter_vagolinensis'", 1), ("vagolinensis, Dincanedobacter", 1), ("Dincanedobacter vagolinensis subsp. rubra", 1),
        ("Dincanedobacter vagolinensis strain B94", 1), ("Dincanedobacter vagolinensis (taxid 99)", 1), ("Dincanedobacter_vagolinensis_21", 1), ("s__Dincanedobacter vagolinensis", 1),
        ("Candidatus Dincanedobacter vagolinensis?", 1), ("[Dincanedobacter] vagolinensis;", 1), ("Dincanedobactervagolinensis", 1), ("Dincanedobacter vagolin ensis", 1),
        ("Dincanedobacter vagolin-ensis", 1), ("Dincanedobаcter vagolinensis", 1), ("Dincanedobacter vagolïnensis", 1), (" Dincanedobacter vagolinensis", 1),
        ("Dincanedobcater vagolinensis", 1), ("Dincancdobacter vaqolinensis", 1), ("D. vagolinensis", 1), ("Dinc. vagolinensis", 1), ("Klusospira turolinar.", 3), ("Q. durolinatus", 4),
        ("Nullothrix turedinoides", 1), ("Quentonema durolimatus", 4), ("Quentonerna durolinatus", 4),
        ("Dincanedobacter", None), ("Dincanedobacter sp. C38", None), ("Dincanedobacter rubra", None), ("Zellobacter vagolinensis", None), ("K. durolinatus", None), ("plasmid pR5", None),
        ("???", None), ("", None), ("see sheet 2", None), ("x" * 5000, None), ("D.", None),
    ],
)
def test_lookup(dictionary, value, expected):
    found = dictionary.lookup(value)
    assert (found and found[2]) == expected


def plain_distance(a, b):
    """Optimal string alignment without weights."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def test_symmetric_deletes_find_all_within_bound():
    """Every pair within the bound shares a key, as brute force over random edits shows."""
    import random

    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(8, 24)))
        other = list(word)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(other))
            rng.choice((lambda: other.pop(k), lambda: other.insert(k, rng.choice("abcde")), lambda: other.__setitem__(k, rng.choice("abcde"))))()
        other = "".join(other)
        if plain_distance(word, other) <= species.MAX_EDITS:
            assert species.deletes(word, species.MAX_EDITS) & species.deletes(other, species.MAX_EDITS)


def test_match_species(spark):
    reference = spark.createDataFrame([(7, "Aaabacter longensis", ["Bbbathrix oldensis"]), (9, "Ccccoccus wideensis", None)], "species_id bigint, species_name string, synonyms array<string>")
    rows = [(1, "Aaabacter longensis", "aaabacter longensis"), (2, None, "  "), (3, "NA", "Bbbathrix oldensis"), (4, "clone 7", "C. wideensis"), (4, "clone 7", "C. wideensis")]
    hits = spark.createDataFrame([(*r, 0) for r in rows], "hit_id bigint, q_species string, t_species string, species_id int")
    want = [(1, "t_species", 7), (3, "t_species", 7), (4, "q_species", 0), (4, "q_species", 0), (4, "t_species", 9), (4, "t_species", 9)]
    assert sorted(tuple(r) for r in species.match_species(hits, reference).collect()) == want
    assert species.match_species(hits.where("false"), reference).count() == 0
    assert {r.species_id for r in species.match_species(hits, reference.where("false")).collect()} == {0}
    values = spark.createDataFrame([("aaabacter longensis",), ("D x",)], "value string")
    for blocks in (1, 2, 100):
        assert {tuple(r) for r in species.resolve_values(values, reference, block_names=blocks).collect()} == {("aaabacter longensis", 7), ("D x", 0)}
