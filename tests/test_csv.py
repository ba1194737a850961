"""Delimited files: sniffing, records, lines, and the way back."""

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabprofile.plans.table import ROW
from tabprofile.sources import csv as C


def read(spark, tmp_path, data, **options):
    path = tmp_path / "in.csv"
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    t = C.read_csv(spark, str(path), **options)
    return t, [tuple(r[c.name] for c in t.columns) for r in t.df.orderBy(ROW).collect()]


def test_records(spark, tmp_path):
    t, rows = read(spark, tmp_path, 'a,b, \n1,"x ""q"" y",\n\n2\n3,"m\nn",z,w\r\n""\n  \n4,mid"dle,"q"tail\n')
    assert [c.title for c in t.columns] == ["a", "b", "column 3"]
    assert rows == [("1", 'x "q" y', ""), ("2", "", ""), ("3", "m\nn", "z"), ("  ", "", ""), ("4", 'mid"dle', "qtail")]
    assert [r["_line"] for r in t.df.orderBy(ROW).collect()] == [2, 4, 5, 8, 9]


def test_sniffing(spark, tmp_path):
    assert C.detect_delimiter(["a;b", "1,5;2,5", "1,2,3;4"]) == ";"
    assert C.detect_delimiter(["a\tb|c", "1\t2"]) == "\t"
    assert C.detect_delimiter(['"a,b";c', "1;2"]) == ";"
    assert C.detect_delimiter(["x"]) == ","
    t, rows = read(spark, tmp_path, "a;b\né;€\n".encode("cp1252"))
    assert (t.encoding, t.delimiter, rows) == ("windows-1252", ";", [("é", "€")])
    t, rows = read(spark, tmp_path, "﻿a,b\n1,2\n".encode("utf-16be"))
    assert (t.encoding, rows) == ("utf-16be", [("1", "2")])
    t, rows = read(spark, tmp_path, b"\xef\xbb\xbfa,b\n1,2\n")
    assert ([c.title for c in t.columns], rows) == (["a", "b"], [("1", "2")])
    assert read(spark, tmp_path, b"")[1] == []


def test_lone_carriage_returns_end_lines(spark, tmp_path):
    t, rows = read(spark, tmp_path, "a,b\r1,2\r3,4\r")
    assert ([c.title for c in t.columns], rows) == (["a", "b"], [("1", "2"), ("3", "4")])
    assert [r["_line"] for r in t.df.orderBy(ROW).collect()] == [2, 3]
    # Mixed ends; inside quotes they stay what they are.
    _, rows = read(spark, tmp_path, 'a,b\n1,"x\ry"\r2,"x\r\ny"\r\n3,"x\ny"\r\r4,5')
    assert rows == [("1", "x\ry"), ("2", "x\r\ny"), ("3", "x\ny"), ("4", "5")]
    _, rows = read(spark, tmp_path, 'a,b\r1,"x\ry"\r')
    assert rows == [("1", "x\ry")]
    path = str(tmp_path / "in.csv")
    assert [r["text"] for r in C.raw_lines(spark, path).orderBy("_line").collect()] == ["a,b", '1,"x', 'y"', ""][:3]


def test_wide_files_are_cut_between_units(spark, tmp_path):
    """Characters whose bytes look like a line feed across a border."""
    text = "a,b\n\u0a41\u4100,x\n" + "\u410a\u0041\u0a00\u000b,\u0a0a\u0a00y\n" * 3 + "end,\u0a41\u0042"
    for encoding in ("utf-16le", "utf-16be"):
        t, rows = read(spark, tmp_path, ("\ufeff" + text).encode(encoding))
        assert t.encoding == encoding
        assert rows == [tuple(line.split(",")) for line in text.split("\n")[1:]], encoding
    t, rows = read(spark, tmp_path, "\ufeffa,b\r1,2\r".encode("utf-16le"))
    assert rows == [("1", "2")]


def test_truncated_tables_say_so(spark, tmp_path):
    from tabprofile.operators.diagnose import dataset_info

    text = "a\n1\n2\n3\n"
    for most, said, n in ((2, True, 2), (3, False, 3), (None, False, 3)):
        t, rows = read(spark, tmp_path, text, max_rows=most)
        assert (t.truncated, len(rows), dataset_info(t).first()["truncated"]) == (said, n, said)


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    monkeypatch.setattr(C, "MAX_RECORD_LINES", 5)
    assert len(read(spark, tmp_path, 'a\n"1\n2\n3\n4\n5"\n6\n')[1]) == 2
    with pytest.raises(PySparkException, match="the record of line 3 has more than 5 lines"):
        read(spark, tmp_path, 'a\n1\n"2\n3\n4\n5\n6\n7\n')


def test_segments(spark):
    lines = ['a,"b,c",,d"e,f"', "", ",x,", '"open, and on', "long " * 20_000 + ',"' + "q,"  * 20_000 + '"', "a,b" * 3000]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select("l", C.raw_segments(F.col("l"), ",").alias("s"))
    for r in df.collect():
        assert "".join(p["text"] for p in r["s"]) == r["l"]
    assert [p["column"] for p in df.first()["s"]] == [0, -1, 1, -1, -1, 3]


def test_round_trip_and_copies(spark, tmp_path):
    cells = [("1", ' pad"'), ("2", "a;b"), ("3", "x\ny"), ("4", "")]
    text = "n;s\n" + "".join(f'{a};"{b.replace(chr(34), chr(34) * 2)}"\n' for a, b in cells)
    t, rows = read(spark, tmp_path, text)
    assert rows == cells
    first, second = (C.save_clean_copy(t, str(tmp_path / "data.csv")) for _ in range(2))
    assert first.endswith("data.clean.csv") and second.endswith("data.clean-2.csv")
    parts = sorted((tmp_path / "data.clean.csv").glob("part-*"))
    again = b"".join(p.read_bytes() for p in parts).decode()
    assert again == 'n;s\n1;" pad"""\n2;"a;b"\n3;"x\ny"\n4;\n'
    lines = [r["line"] for r in C.selected_rows_text(t, [1, 3]).orderBy(ROW).collect()]
    assert lines == ["2\ta;b", "4\t"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab,"\n ', max_size=6), min_size=3, max_size=3), min_size=1, max_size=8))
def test_any_cells_come_back(spark, tmp_path, cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["h", "i", "j"], *cells])
    _, rows = read(spark, tmp_path, out.getvalue(), delimiter=",", encoding="utf-8", types=False)
    assert rows == [tuple(r) for r in cells]


def test_empty_first_cells_and_open_quotes(spark):
    """An empty first cell leaves the next one; a quote that is never closed holds what is left."""
    from tabprofile.sources.csv import read_records

    lines = [";1,5;x", 'a;"q;""r"""', '"x""";;;', ";", '"";z', ";;", ';"p;q']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "_line long, text string")
    got = [r["fields"] for r in read_records(df, ";").orderBy("_line").collect()]
    assert got == [["", "1,5", "x"], ["a", 'q;"r"'], ['x"', "", "", ""], ["", ""], ["", "z"], ["", "", ""], ["", "p;q"]]
