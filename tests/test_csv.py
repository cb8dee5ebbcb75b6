"""Multi-line CSV read by many tasks equals the read of the whole file by one."""

import csv as pycsv
import random

import pytest
from pyspark.sql import functions as F

from tabwright.sources import csv as CSV


def nasty(path, n, seed, crlf=False):
    rnd = random.Random(seed)
    bits = ["a", "Zürich", ",", '"', "\n", "\r\n", "", " ", '""', "\n\n", '",', ',"', "x" * 40, "NA", "1"]
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = pycsv.writer(f, lineterminator="\r\n" if crlf else "\n")
        w.writerow(["id", "first\nname" if seed % 2 else "name", " note "])
        for i in range(n):
            w.writerow([i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))])
        f.write("\n")


def rows(df):
    return ordered(tuple(r) for r in df.collect())


def ordered(found):
    return sorted(found, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("seed,crlf,size", [(1, False, 700), (2, True, 5000), (3, False, 64)])
def test_ranges_equal_whole_file(spark, tmp_path, seed, crlf, size):
    for k in range(2):
        nasty(tmp_path / f"f{k}.csv", {64: 12, 700: 90}.get(size, 400), seed + 2 * k, crlf)
    one = CSV.read_csv(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert CSV._lines(spark, str(tmp_path)).select("file", "start").distinct().count() > 8
        many = CSV.read_csv(spark, str(tmp_path))
        assert rows(many) == rows(one)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for k in range(2):
        with open(tmp_path / f"f{k}.csv", newline="", encoding="utf-8") as f:
            want += [r for r in list(pycsv.reader(f))[1:] if r]
    want = ordered((int(r[0]), *(None if x in CSV.NA_TOKENS else x for x in r[1:])) for r in want)
    assert rows(one) == want
    assert one.columns == ["id", "first\nname" if seed % 2 else "name", "note"]


def test_stray_quotes_as_spark_reads_them(spark, tmp_path):
    """A quote opens a field as its first character only."""
    (tmp_path / "s.csv").write_text('a,b\n5" pipe,x\ny,6"\n"q ""in"" q",z\n"two\nlines",w\n')
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
    assert rows(CSV.read_csv(spark, str(tmp_path))) == rows(whole)
    assert whole.count() == 4


def test_open_after():
    cases = [("a,b", 0, 0), ('"a', 0, 1), ('a"', 0, 0), ('a"', 1, 0), ('a""', 1, 1), ('a"""', 1, 0), ('x","y', 1, 1), ('"a""b",c', 0, 0), ('a,"', 0, 1), ("", 1, 1), ('",', 1, 0), ('","', 1, 1)]
    for line, before, after in cases:
        assert CSV.open_after(line, bool(before)) == bool(after), line


def test_states_of_ranges(spark):
    """The composed state equals the walk through all ranges, for maps of every kind."""
    rnd = random.Random(5)
    maps = [(f"f{k}", 10 * i, *rnd.choice([(False, True), (True, False), (True, True), (False, False), (False, True), (True, False)]), True, rnd.random() < 0.5)
            for k in range(6) for i in range(12)]
    df = spark.createDataFrame(maps, "file string, start long, end0 boolean, end1 boolean, has0 boolean, has1 boolean")
    got = {(r.file, r.start): (r.is_open, r.owner) for r in CSV.range_states(df).collect()}
    for k in range(6):
        state, owner = False, None
        for file, start, e0, e1, h0, h1 in (m for m in maps if m[0] == f"f{k}"):
            assert got[file, start] == (state, owner)
            owner = start if (h1 if state else h0) else owner
            state = e1 if state else e0


def test_header_only_and_empty_values(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert CSV.read_csv(spark, str(tmp_path / "h.csv")).columns == ["a", "b"]
    assert CSV.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "v.csv").write_text('a,b\n1,True\n"",false\n3\n')
    got = CSV.read_csv(spark, str(tmp_path / "v.csv"))
    assert dict(got.dtypes) == {"a": "bigint", "b": "boolean"}
    assert {tuple(r) for r in got.collect()} == {(1, True), (None, False), (3, None)}
    assert got.agg(F.count("b")).collect()[0][0] == 2
