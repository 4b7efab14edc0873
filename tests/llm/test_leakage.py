import random

import pyarrow as pa

from phylospan.llm import leakage

COMMON = "the old mill near the river was sold and the new owner rebuilt".split()


def vocabulary(rng, n):
    return [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{k}" for k in range(n)]


def test_words():
    texts = ["''Hello'',&nbsp;W­orld! <b>a</b>&#44; [[Link|tExt]] {{nowrap|In}}line\n|| cell<!-- hid --> <ref name=\"x\" />é", None, "", "é"]
    assert leakage.words_of(pa.array(texts)).to_pylist() == [["hello", "world", "a", "text", "in", "line", "cell", "hid", "e"], [""], [""], ["e"]]


def mutate(rng, words, every):
    out = []
    for k, w in enumerate(words):
        if k % every == every // 2:
            kind = rng.choice(("change", "drop", "add"))
            if kind == "drop":
                continue
            out += ["zzz"] if kind == "change" else [w, "also"]
        else:
            out.append(w)
    return out


def test_found_and_not_found(spark):
    rng = random.Random(4)
    words = vocabulary(rng, 400)
    items = {k: [rng.choice(words) if rng.random() < 0.6 else rng.choice(COMMON) for _ in range(rng.randint(30, 70))] for k in range(1, 9)}
    fill = lambda n: [rng.choice(words) if rng.random() < 0.4 else rng.choice(COMMON) for _ in range(n)]
    docs, expected = [], set()
    for n in range(120):
        item = rng.choice(list(items))
        kind = n % 6
        if kind == 0:
            at, size = rng.randint(0, 10), rng.randint(15, 20)
            passage = items[item][at : at + size]
        elif kind == 1:
            passage = mutate(rng, items[item], 8)
        elif kind == 2:
            at = rng.randint(0, 10)
            passage = [f"'''{w.upper()}'''," if k % 3 else f"[[{w}]]\n" for k, w in enumerate(items[item][at : at + 18])]
        elif kind == 3:
            passage = rng.sample(items[item], len(items[item]))
        elif kind == 4:
            at = rng.randint(0, 10)
            passage = items[item][at : at + 9] + fill(6) + items[item][at + 10 : at + 19]
        else:
            passage = []
        docs.append((n, " ".join(fill(60) + passage + fill(60))))
        if kind < 3:
            expected.add((n, item))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    rows = [(k, " ".join(w), "y") for k, w in items.items()] + [(90, None, "y"), (91, "too short", "y"), (None, "x " * 40, "y")]
    tests = spark.createDataFrame(rows, "item_id bigint, text string, doc_id string")
    for words_ in (100_000, 120):
        assert {tuple(r) for r in leakage.find_leaks(df, tests, block_words=words_).collect()} == expected
    assert leakage.find_leaks(df, tests.where("false")).count() == 0 and leakage.find_leaks(df.where("false"), tests).count() == 0


def test_extra_columns_and_long_text(spark):
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, "filler word " * 50_000 + text, 5)], "doc_id bigint, text string, term int")
    items = spark.createDataFrame([(7, text)], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.find_leaks(df, items).collect()] == [(1, 7)]


def test_changed_words_whose_neighbours_are_common(spark):
    """Words 3 and 7 of a lone leak of fifteen are changed; the terms that this breaks are the item's rarest."""
    item = [f"v{k}" for k in range(15)]
    leak = [f"new{k}" if k in (3, 7) else w for k, w in enumerate(item)]
    df = spark.createDataFrame([(1, " ".join(["filler"] * 20 + leak + ["filler"] * 20)), (2, " ".join(item[8:12]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.find_leaks(df, items).collect()] == [(1, 7)]


def test_many_words_and_all_chains():
    """Keys of a block of many words stay apart, and a chain that is neither the longest nor the cleanest so far is kept."""
    import numpy as np
    import pandas as pd

    words = [[f"w{k}" for k in range(a, a + 40)] for a in range(0, 40_000, 40)]
    index = leakage.TermIndex(words)
    terms = index.terms(index.keys(index.code(words[-1])))
    assert (np.diff(terms) == 1).all() or len(set(terms.tolist())) == 38
    assert len(index.sorted) == 38_000 and index.terms(index.keys(np.array([0, 1, 3], np.int64))).tolist() == [-1]
    run = lambda first, last, off, lost: {"first": first, "last": last, "off": off, "lost": lost}
    judge = lambda *runs: bool(leakage._leaks.func(pd.Series([list(runs)]))[0])
    assert judge(run(0, 14, 0, 0)) and not judge(run(0, 13, 0, 0))
    assert judge(run(0, 7, 0, 0), run(9, 17, 0, 0)) and not judge(run(0, 4, 0, 0), run(30, 44, 20, 3))
    assert judge(run(0, 9, 0, 0), *(run(11 + k, 16, k - 3, 1) for k in range(3)), run(11, 20, 0, 0))


def test_changes_near_the_ends(spark):
    """Fifteen words with the third from an end, or from both, changed, added or dropped; a chance word beyond a change is no passage."""
    item = [f"w{k}" for k in range(40)]
    changed = lambda p, *at: [("zz" if k in at else w) for k, w in enumerate(p)]
    dropped = lambda p, at: p[:at] + p[at + 1 :]
    added = lambda p, at: [*p[:at], "zz", *p[at:]]
    part = item[10:25]
    leaks = [changed(part, 2), changed(part, 12), changed(part, 2, 12), dropped(part, 2), dropped(part, 12), added(part, 2), added(part, 13), [*changed(part, 2)]]
    others = [changed(part, 1), changed(part[:14], 2), changed(part[:14], 11), added(part[:14], 2), changed(part, 3, 11, 7), part[:14], [part[0], "zz", *part[2:14], "zz"], ["zz", part[1], *part[3:]]]
    frame = [" ".join(["x1 x2", *p, "x3 x4"]) for p in leaks + others] + [" ".join(p) for p in leaks]
    df = spark.createDataFrame(list(enumerate(frame)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"v{k}" for k in range(20)))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, items).collect()}
    assert got == {(k, 1) for k in [*range(len(leaks)), *range(len(leaks + others), len(frame))]}


def test_only_runs_within_reach_that_cover_enough_are_judged_one_by_one(spark, monkeypatch):
    """Scattered stock phrases and single runs are judged by arrays; results are those of judging all runs one by one."""
    rng = random.Random(9)

    def runs():
        out, at, off = [], rng.randint(0, 9), 0
        for _ in range(rng.randint(1, 7)):
            size = rng.randint(3, 9)
            out.append((at, at + size - 1, off, rng.choice((0, 0, 0, 1)), rng.choice((0, 0, 2, 3)), rng.choice((0, 0, 2, 3))))
            at, off = max(0, at + size + rng.choice((-3, -1, 0, 1, 1, 2, 3, 5, 6, 9, 30))), off + rng.choice((-2, -1, 0, 0, 0, 1, 2, 7))
        return out

    as_rows = lambda cases: pa.array([[dict(zip(leakage.RUN_COLUMNS, r)) for r in case] for case in cases])
    cases = [runs() for _ in range(20_000)]
    expected = [leakage._is_passage(sorted(case)) for case in cases]
    assert 500 < sum(expected) < 15_000
    assert leakage._leaks.func(as_rows(cases)).to_pylist() == expected
    assert leakage._leaks.func(as_rows(cases)[10:90]).to_pylist() == expected[10:90]
    monkeypatch.setattr(leakage, "_is_passage", None)
    scattered = [[(k * 20, k * 20 + 6, k, 0, 0, 0) for k in range(9)], [(0, 14, 3, 0, 0, 0), (40, 46, 1, 0, 0, 0)], [(0, 4, 0, 0, 0, 0), (6, 11, 0, 0, 0, 0)]]
    assert leakage._leaks.func(as_rows(scattered)).to_pylist() == [False, True, False]
