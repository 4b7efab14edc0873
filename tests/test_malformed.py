import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phylospan.operators import malformed as m

GOOD = ["48", "0", "0", "0", "0", "0", "0", "0", "-", "ctg1", "100", "10", "58", "t1", "900", "5", "53", "1", "48,", "10,", "5,"]


def line(**changes):
    fields = list(GOOD)
    for key, value in changes.items():
        fields[int(key[1:])] = value
    return "\t".join(fields)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (line(), None),
        (line(f9='"ctg 1"'), "q_name"),
        (line(f9='"ct""g"'), None),
        (line(f9='" ctg1 "'), None),
        (line(f9='"ct\tg"'), "q_name"),
        (line(f9='ct"g'), "quoting"),
        (line(f9='"ctg1'), "quoting"),
        (line(f9='"ctg1" '), "quoting"),
        (line(f18='"48," '), "quoting"),
        (line() + "\t", "columns"),
        (line().replace("\t", ";"), "columns"),
        (line(f9=""), "q_name"),
        (line(f9="UnKnown"), "q_name"),
        (line(f9="ctgé"), "q_name"),
        (line(f12='"58"'), None),
        (line(f12=" 58 "), None),
        (line(f12="5 8"), "q_end"),
        (line(f12="٥"), "q_end"),
        (line(f12="10"), "q_end"),
        (line(f12="101"), "q_end"),
        (line(f10="9" * 30, f12="8" * 25), None),
        (line(f9="", f12="x"), "q_name"),
        (line(f9="x" * 100_000), None),
    ],
)
def test_diagnose(text, reason):
    assert m.diagnose(text)[1] == reason


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["", "1", "a", '"', '"a"', "\t", "58", " 7 ", "na", "99999999999999999999", "é", '"x""y"'])), max_size=12))
def test_bulk_agrees_with_strict(changes):
    """Blocks give every record the strict parser's verdict, wherever the bad ones lie."""
    lines = [line(**{f"f{k}": value}) for k, value in changes] + [line()] * 3
    parts = []
    m._bisect(pa.array(lines, pa.string()), 0, len(lines), 2, parts)
    covered = []
    for low, high, fields in parts:
        covered += range(low, high)
        if fields is not None:
            for k, row in zip(range(low, high), fields.to_pylist()):
                assert m.diagnose(lines[k]) == (row, None)
    assert covered == list(range(len(lines)))


def frame(spark, rows):
    return spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, raw_line string, reason string")


def test_table(spark):
    rows = [
        (1, "f", 1, "psLayout", "x"), (2, "f", 6, None, "x"), (3, "f", 7, "  ", "x"), (4, "f", 8, "# note", "x"), (5, "f", 9, line() + "\r", "x"),
        (6, "f", 10, line(f9="NA") + "\r", "x"), (7, "f", None, "junk", "x"), (8, "f", 11, line(), None), (9, "f", 12, "\r", "x"), (10, "f", 13, line() + "\r\r", "x"),
    ]
    df = frame(spark, rows)
    assert {tuple(r) for r in m.rejected_lines(df).collect()} == {(6, "q_name"), (7, "columns")}
    hits = {r.line_id: r for r in m.sound_hits(df).collect()}
    assert set(hits) == {5, 8, 10} and hits[5].q_end == 58 and hits[5].block_sizes == [48]
    assert m.rejected_lines(df.where("false")).count() == 0 and m.sound_hits(df.where("false")).count() == 0
    assert m.sound_hits(frame(spark, [(1, "f", 9, line(f0="many", f18="1,x,"), None)])).first().asDict() | {} == m.sound_hits(frame(spark, [(1, "f", 9, line(f0="many", f18="1,x,"), None)])).first().asDict()
    huge = m.sound_hits(frame(spark, [(1, "f", 9, line(f10="0" * 5000 + "99", f11="0" * 4500 + "7"), None), (2, "f", 9, line(f10="9" * 25), None)])).collect()
    assert {(r.line_id, r.q_size, r.q_start, tuple(r.too_large)) for r in huge} == {(1, 99, 7, ()), (2, None, huge[1].q_start, ("q_size",))}
    odd = m.sound_hits(frame(spark, [(1, "f", 9, line(f0="many", f18="1,x,"), None)])).first()
    assert odd.n_match is None and odd.block_sizes == [1, None]
