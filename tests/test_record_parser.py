import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorix.operators import record_parser as rp

CASES = [
    ("triple", "1,2,3.5", None),
    ("triple", ' 1 , 2 ,3.5 \r', None),
    ("triple", '"1",2,"3."', None),
    ("triple", '1,2,"3', "quoting"),
    ("triple", '1,2"x,3', "quoting"),
    ("triple", ' "1",2,3', "quoting"),
    ("triple", '"1" ,2,3', "quoting"),
    ("triple", '"1","2","3" ', None),
    ("triple", "1,2", "column_count"),
    ("triple", "1,2,3,4", "column_count"),
    ("triple", None, "column_count"),
    ("triple", " \r ", "column_count"),
    ("triple", "-1,2,3", "row_idx"),
    ("triple", "2147483648,2,3", "row_idx"),
    ("triple", "0002147483647,2,3", None),
    ("triple", "１,2,3", "row_idx"),
    ("triple", '" 1",2,3', "row_idx"),
    ("triple", "1,x,3", "col_idx"),
    ("triple", "1,,3", "col_idx"),
    ("triple", "1,2,", "value"),
    ("triple", "1,2,.", "value"),
    ("triple", "1,2,1e39", "value"),
    ("triple", "1,2,nan", "value"),
    ("triple", "1,2,+.5E-3", None),
    ("triple", "1,2,1e-400", None),
    ("noted", '1,2,3,"a, ""b"""', None),
    ("noted", "1,2,3,", None),
    ("noted", "1,2,3,a,b", "column_count"),
    ("movielens", "1::2::3::4", None),
    ("movielens", "1:: 2 ::3::4\r", None),
    ("movielens", '1::"2"::3::4', "col_idx"),
    ("movielens", "1:::2::3::4", "col_idx"),
    ("movielens", "1::2::3", "column_count"),
    ("movielens", "1::2::3::x", "ts"),
    ("adjacency", "1\t2:3 4:5", None),
    ("adjacency", "1\t2:3   4:5 ", None),
    ("adjacency", "1\t", "column_count"),
    ("adjacency", "1 2:3", "column_count"),
    ("adjacency", "1\t2:3\t4:5", "column_count"),
    ("adjacency", "1\t2:3:4", "column_count"),
    ("adjacency", "x\t2:3", "row_idx"),
    ("adjacency", "1\t2:x y:3", "col_idx"),
    ("adjacency", "1\t2:x 3:3", "value"),
    (None, "1,2,3", "feed"),
    ("other", "1,2,3", "feed"),
]


@pytest.mark.parametrize(("feed", "line", "reason"), CASES)
@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_cases(feed, line, reason, chunk):
    rows = rp.parse_batch([7], [feed], [line], chunk).to_pylist()
    assert {r["reason"] for r in rows} == {reason}
    assert all((r["offset"] is None) == (reason is None) for r in rows)


def test_values():
    rows = rp.parse_batch([1, 2], ["noted", "adjacency"], ['"5",6,-1.5e0,"say ""hi"", ok"', "3\t4:.5 4:1"]).to_pylist()
    noted = next(r for r in rows if r["feed"] == "noted")
    assert (noted["row_idx"], noted["col_idx"], noted["value"], noted["note"]) == (5, 6, -1.5, 'say "hi", ok')
    assert [(r["ordinal"], r["col_idx"], r["value"]) for r in rows if r["feed"] == "adjacency"] == [(0, 4, 0.5), (1, 4, 1.0)]


def slow(line):
    """(state, separators) of the quoting rules, byte by byte."""
    state, seps = "start", []
    for i, ch in enumerate(line):
        if state == "broken":
            continue
        if state in ("start", "plain"):
            if ch == '"':
                state = "quoted" if state == "start" else "broken"
            elif ch == ",":
                state, _ = "start", seps.append(i)
            else:
                state = "plain"
        elif state == "quoted":
            state = "closing" if ch == '"' else "quoted"
        else:
            state = "quoted" if ch == '"' else "start" if ch == "," else "broken"
            if ch == ",":
                seps.append(i)
    return state, seps


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a",', max_size=40), min_size=1, max_size=8), st.integers(1, 9))
def test_tokenizer_matches_slow_automaton(lines, chunk):
    raw = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in raw])
    starts = ends - [len(x) for x in raw]
    data = np.frombuffer(b"".join(raw), np.uint8)
    before, final, fault = rp.tokenize(data, starts, ends, chunk)
    names = ("start", "plain", "quoted", "closing", "broken")
    for i, line in enumerate(lines):
        state, seps = slow(line)
        assert names[final[i]] == state
        if state != "broken":
            mine = [j - starts[i] for j in range(starts[i], ends[i]) if data[j] == ord(",") and before[j] != rp.QUOTED]
            assert mine == seps
        assert (fault[i] >= 0) == (state == "broken")


def test_frame_with_nulls_extra_columns_and_no_rows(spark):
    schema = "line_id bigint, feed string, line string, reason string, row_idx string"
    rows = [(1, "triple", "1,2,3", "x", "y"), (None, "triple", None, None, None), (1, "triple", "1,2,3", "x", "y"), (2, None, '"', None, None)]
    parsed = rp.parse_lines(spark.createDataFrame(rows, schema))
    assert rp.records(parsed).count() == 2
    assert {(r.line_id, r.reason) for r in rp.rejects(parsed).collect()} == {(None, "column_count"), (2, "feed")}
    assert rp.parse_lines(spark.createDataFrame([], schema)).count() == 0


def test_long_line(spark):
    long = '1,2,3,"' + "x," * 200_000 + '"'
    rows = rp.parse_batch([1, 2], ["noted", "noted"], [long, long[:-1]]).to_pylist()
    assert [r["reason"] for r in rows] == [None, "quoting"]
    assert math.isclose(rows[0]["value"], 3.0)
