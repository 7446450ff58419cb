"""Rows that fail to parse, against a state machine written out by hand."""

import datetime as dt
import random

import pytest

from weftline.functions.records import BadRecord, assemble, read_float, read_int, split_record, typed
from weftline.operators import badrows

LINES = "file_id bigint, line_no int, raw_line string, loaded_at timestamp_ntz, reason string"
CHARS = "characterization_id bigint, file_id bigint, file_name string, header boolean, field_separator string, record_separator string, skip_lines int, column_names array<string>, column_types array<string>, characterized_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def brute(raw, sep):
    """Fields by a plain state machine; None where the quoting is broken or a line break is bare."""
    out, at = [], 0
    while True:
        if at < len(raw) and raw[at] == '"':
            at += 1
            value = ""
            while True:
                if at >= len(raw):
                    return None
                if raw[at] == '"':
                    if raw[at + 1 : at + 2] == '"':
                        value += '"'
                        at += 2
                        continue
                    at += 1
                    break
                value += raw[at]
                at += 1
            if at < len(raw) and raw[at] != sep:
                return None
            out.append(value)
        else:
            value = ""
            while at < len(raw) and raw[at] != sep:
                if raw[at] in '"\n\r':
                    return None
                value += raw[at]
                at += 1
            out.append(value)
        if at >= len(raw):
            return out
        at += 1


@pytest.mark.parametrize("sep", [",", "~", "\t", "||"])
def test_split_is_the_state_machine(sep):
    rng = random.Random(4)
    for _ in range(4000):
        raw = "".join(rng.choice('ab"" ,~\t\n|') for _ in range(rng.randint(1, 9)))
        one = raw.replace("||", "\1").replace("|", "p").replace("\1", "||") if sep == "||" else raw
        want = brute(one.replace("||", "\1"), "\1") if sep == "||" else brute(one, sep)
        want = want and [x.replace("\1", "||") for x in want]
        try:
            got = split_record(one, sep)
        except BadRecord:
            got = None
        assert got == want, repr(one)


def test_line_ends():
    assert split_record('a,"b"\r', ",", True) == ["a", "b"]
    assert split_record("a,b\r", ",", False) == ["a", "b\r"]
    with pytest.raises(BadRecord):
        split_record('a,"b"\r', ",", False)
    assert split_record('"x\ny",z') == ["x\ny", "z"]
    assert split_record("x" * 300_000 + ",y")[1] == "y"


@pytest.mark.parametrize("text", ["9223372036854775808", "1.0", "--1", "1_0", "٣", "", "0x1", "9" * 5000])
def test_bad_ints(text):
    with pytest.raises(ValueError):
        read_int(text)


def test_numbers():
    assert read_int("-9223372036854775808") == -(2**63) and read_int("+0007") == 7 and read_int("0" * 5000 + "5") == 5
    for bad in ("1.2.3", "e5", ".", "1e", "inf", "nan", "1,0"):
        with pytest.raises(ValueError):
            read_float(bad)
    assert read_float(".177") == 0.177 and read_float("5.") == 5 and read_float("6.4e+03") == 6400


def test_typed_values():
    assert typed(' 7 ,"null", NA ,2024-02-29,YES', ["int", "string", "float", "date", "boolean"], ",", False) == [7, None, None, dt.date(2024, 2, 29), True]
    for raw, reason in (("1", "wrong column count"), ("x,2", "invalid value"), ('"1,2', "broken quoting")):
        with pytest.raises(BadRecord, match=reason):
            typed(raw, ["int", "int"], ",", False)
    with pytest.raises(BadRecord):
        typed("2023-02-29", ["date"], ",", False)


def test_assemble():
    assert list(assemble(['a,"b', 'c"', "d", 'e,"f'])) == ['a,"b\nc"', "d", 'e,"f']
    lines = [f"{n},x" for n in range(1000)]
    lines[3] = '3,5" pipe'  # a stray quote opens nothing
    assert list(assemble(lines)) == lines
    lines[7] = '7,"never closed'
    lines[20] = '20,"fine"'
    assert list(assemble(lines)) == lines  # nor does one that is closed by another record's quote swallow records
    assert list(assemble(['a;"x', 'y";1', '2;"p""q', 'r"'], ";")) == ['a;"x\ny";1', '2;"p""q\nr"'] and list(assemble([])) == []


def test_tables(spark, collected):
    lines = [
        (1, 1, "preamble", T0, "x"), (1, 2, "a;b", T0, "x"), (1, 3, "1;2", T0, "x"), (1, 3, "1;2", T0 + dt.timedelta(1), "x"),
        (1, 4, "z;2", T0, "x"), (1, 5, "  ", T0, "x"), (1, 6, None, T0, "x"), (1, 7, "1", T0, None),
        (2, 1, "c", T0, None), (2, 2, "5", None, None), (3, 2, "q", T0, None), (4, 2, "1,2", T0, None),
    ]
    chars = [
        (1, 1, "f", False, ",", "\n", 0, ["a"], ["int"], T0), (2, 1, "f", True, ";", "\n", 1, ["a", "b"], ["int", "int"], T0 + dt.timedelta(1)),
        (3, 2, None, None, None, None, None, ["c"], ["int"], T0), (4, 4, None, None, None, None, None, None, None, T0),
    ]
    ls, cs = spark.createDataFrame(lines, LINES), spark.createDataFrame(chars, CHARS)
    got = collected(badrows.rejects(ls, cs))
    assert [(a, b) for a, b, _ in got] == [(1, 4), (1, 6), (1, 7), (3, 2), (4, 2)]
    assert dict(((a, b), r) for a, b, r in got)[3, 2] == "no declared columns"
    ok = badrows.parse_lines(ls, cs).where("reason is null")
    assert collected(ok, "file_id", "line_no", "cells") == [(1, 3, ["1", "2"]), (2, 2, ["5"])]
    assert collected(badrows.value_lines(badrows.parse_lines(ls, cs), cs)) == [(1, 3, "a", "int", "1"), (1, 3, "b", "int", "2"), (2, 2, "c", "int", "5")]
    assert collected(badrows.typed_rows(ls, cs, ["a", "b"], ["int", "int"])) == [(1, 3, 1, 2)]
    assert badrows.rejects(ls.limit(0), cs).count() == 0
    assert badrows.rejects(ls, cs.limit(0)).count() == 8
    assert badrows.rejects(ls.limit(0), cs.limit(0)).count() == 0


def test_clashing_names(spark, collected):
    ls = spark.createDataFrame([(1, 1, "3,4", T0, None)], LINES)
    cs = spark.createDataFrame([(1, 1, "f", False, ",", "\n", 0, ["line_no", "line_no"], ["int", "float"], T0)], CHARS)
    df = badrows.typed_rows(ls, cs, ["line_no", "line_no"], ["int", "float"])
    assert df.columns == ["file_id", "line_no", "line_no_1", "line_no_2"] and collected(df) == [(1, 1, 3, 4.0)]


def test_whole_files(spark, tmp_path, collected):
    (tmp_path / "a.csv").write_bytes('h,i\n1,"x\ny"\n2,z\n'.encode())
    got = badrows.read_records(spark, str(tmp_path)).select("line_no", "raw_line")
    assert collected(got) == [(1, "h,i"), (2, '1,"x\ny"'), (3, "2,z")]
