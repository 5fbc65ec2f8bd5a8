from __future__ import annotations

import time

import pytest

from loomline.functions.fields import FieldError
from loomline.operators import breakpoints
from loomline.operators import relational as R
from loomline.sources.files import scan_delimited
from loomline.sources.generate import generate

# The tuples of the operators' known cases.
WORDS = ["Asia", "Europe", "some", "important", "keywords", "Japan", "cat", "cat boomer", "cat lover", "asia"]
INTS = [1234, 1, 3, 5, 7832, 0, -1, 222, 4567, 0]
TRIPLES = [("Asia", 1, "xa"), ("Europe", 2, "xa"), ("some", 3, "xb"), ("important", 4, "xc"), ("keywords", 5, "xc")]
BUILD = [("Asia", 1), ("Europe", 2), ("some", 3), ("important", 4), ("keywords", 5), ("Japan", 6), ("cat", 1), ("cat boomer", 2), ("cat lover", 3), ("asia", 4)]
PROBE = [("Japan", 4), ("cat", 3), ("cat boomer", 2), ("cat lover", 1), ("asia", 0)]


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


@pytest.fixture
def ints(spark):
    return spark.createDataFrame([(n,) for n in INTS], "n int")


def test_keyword(spark, words, rows):
    assert rows(R.keyword_match(words, 0, "cat")) == [("cat",), ("cat boomer",), ("cat lover",)]
    assert rows(R.keyword_match(words, "word", "asia")) == [("asia",)]
    odd = spark.createDataFrame([("a.b%",), ("axb",), (None,)], "w string")
    assert rows(R.keyword_match(odd, 0, ".b%")) == [("a.b%",)]
    assert rows(R.keyword_match(odd.limit(0), 0, "a")) == []


def test_count(words, rows):
    assert rows(R.count_rows(words)) == [(10,)]
    assert rows(R.count_rows(words.limit(0))) == [(0,)]


@pytest.mark.parametrize(
    ("how", "value", "kept"),
    [("Equal", 1, [1]), ("Less", 0, [-1]), ("Greater", 5, [222, 1234, 4567, 7832]), ("GreaterOrEqual", 1234, [1234, 4567, 7832]), ("LessOrEqual", 0, [-1, 0, 0]), ("NotEqual", 0, [-1, 1, 3, 5, 222, 1234, 4567, 7832])],
)
def test_filter(ints, rows, how, value, kept):
    assert rows(R.where(ints, 0, how, value)) == [(n,) for n in kept]


def test_filter_dates(spark, rows):
    days = spark.sql("SELECT * FROM VALUES (timestamp_ntz'1996-01-01 00:00:00'), (timestamp_ntz'1996-01-01 00:00:01'), (null) t(d)")
    assert len(rows(R.where(days, 0, "Greater", "1996-01-01"))) == 1
    assert len(rows(R.where(days, 0, "GreaterOrEqual", "1996-01-01"))) == 2
    with pytest.raises(ValueError, match="unknown comparison"):
        R.where(days, 0, "Like", "x")


def test_filter_is_pushed_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "timestamp_ntz'2020-01-01' AS d", "'x' AS wide").write.parquet(str(tmp_path / "t"))
    plan = R.project(R.where(spark.read.parquet(str(tmp_path / "t")), "d", "Greater", "2020-01-01"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(d" in plan and "wide" not in plan


def test_sort(ints, spark, rows):
    assert [r.n for r in R.sort_by(ints, 0).collect()] == sorted(INTS)
    texts = spark.createDataFrame([("10.0",), ("2.0",), (None,)], "t string")
    assert [r.t for r in R.sort_by(texts, 0).collect()] == [None, "10.0", "2.0"]
    assert [r.n for r in R.sort_by(ints, 0, as_text=True).collect()] == sorted(INTS, key=str)


def test_project(spark, rows):
    df = spark.createDataFrame(TRIPLES, "word string, n int, tag string")
    assert rows(R.project(df, [2])) == [("xa",), ("xa",), ("xb",), ("xc",), ("xc",)]
    assert rows(R.project(df, [0, 2])) == sorted((a, c) for a, _, c in TRIPLES)
    assert R.project(df, [1, "n", 0]).columns == ["n", "n_r", "word"]
    with pytest.raises(FieldError):
        R.project(df, [3])


def test_group_by(spark, rows):
    groups = [("Asia", v) for v in "153"] + [("Europe", v) for v in "24"] + [("Cat", v) for v in "3124"] + [("Japan", "6")]
    df = spark.createDataFrame(groups, "key string, val string")
    assert rows(R.group_by(df, 0, 1, "Average")) == [("Asia", 3.0), ("Cat", 2.5), ("Europe", 3.0), ("Japan", 6.0)]
    assert rows(R.group_by(df, 0, 1, "Sum", as_text=True)) == [("Asia", "9.0"), ("Cat", "10.0"), ("Europe", "6.0"), ("Japan", "6.0")]
    assert rows(R.group_by(df, 0, 1, "Count")) == [("Asia", 3), ("Cat", 4), ("Europe", 2), ("Japan", 1)]
    nulls = spark.createDataFrame([(None, 1), ("a", None), ("b", 2)], "k string, v int")
    assert rows(R.group_by(nulls, 0, 1, "Count")) == [(None, 1), ("a", 0), ("b", 1)]
    assert rows(R.group_by(nulls, 0, 1, "Max", drop_null_groups=True)) == [(None, 1), ("b", 2)]
    assert rows(R.group_by(nulls.limit(0), 0, 1, "Sum")) == []


def test_hash_join(spark, rows):
    inner, outer = spark.createDataFrame(BUILD, "word string, n int"), spark.createDataFrame(PROBE, "word string, n int")
    joined = R.hash_join(inner, outer, 0, 0)
    assert joined.columns == ["word", "n", "n_r"]
    assert rows(joined) == sorted([("Japan", 4, 6), ("cat", 3, 1), ("cat boomer", 2, 2), ("cat lover", 1, 3), ("asia", 0, 4)])
    expected = [("Japan", 4, "important"), ("Japan", 4, "asia"), ("cat", 3, "some"), ("cat", 3, "cat lover"), ("cat boomer", 2, "Europe"), ("cat boomer", 2, "cat boomer"), ("cat lover", 1, "Asia"), ("cat lover", 1, "cat")]
    assert rows(R.hash_join(inner, outer, 1, 1)) == sorted(expected)
    nulls = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "k string, v int")
    assert rows(R.hash_join(nulls, nulls, 0, 0)) == [("a", 2, 2), ("a", 2, 3), ("a", 3, 2), ("a", 3, 3)]
    assert rows(R.hash_join(nulls.limit(0), nulls, 0, 0)) == []


def test_union(words, ints, rows):
    assert len(rows(R.union_all([words, words]))) == 20
    with pytest.raises(ValueError, match="width"):
        R.union_all([words, R.project(ints, [0, 0])])


def test_scan(spark, tmp_path, rows):
    file = tmp_path / "l7.txt"
    file.write_text("1;2;c\n1;4;f;\n5;2;b;\n6;999999;iiii\n8898;6647;kk;")
    kinds = ["int", "int", "string"]
    assert rows(scan_delimited(spark, str(file), ";", fields=kinds)) == [(1, 2, "c"), (1, 4, "f"), (5, 2, "b"), (6, 999999, "iiii"), (8898, 6647, "kk")]
    assert rows(scan_delimited(spark, str(file), ";", keep=[2], fields=kinds)) == [("b",), ("c",), ("f",), ("iiii",), ("kk",)]
    assert scan_delimited(spark, str(file), ";", keep=[2, 0]).columns == ["_c0", "_c2"]
    odd = tmp_path / "odd.txt"
    odd.write_text('1|2|c|\n\n1||"b|\n||x|\n7|8')
    assert rows(scan_delimited(spark, str(odd), "|", fields=3)) == [(None, None, "x"), ("1", None, '"b'), ("1", "2", "c"), ("7", "8", None)]
    assert len(rows(scan_delimited(spark, str(odd), "|", keep=[1], fields=3, drop_empty=True))) == 2
    with pytest.raises(ValueError, match="one character"):
        scan_delimited(spark, str(odd), "||")


def test_generate(spark, rows):
    assert rows(generate(spark, 10)) == [(n,) for n in range(1, 11)]
    assert rows(generate(spark, 10, workers=5)) == sorted([(1,), (2,)] * 5)
    assert rows(generate(spark, 0)) == []


@pytest.mark.parametrize(
    ("limit", "workers", "first", "second", "left"),
    [(10, 5, "n > 1", "n > 1", 5), (10, 1, "n <= 4", "n >= 8", 3), (100_000, 5, "n % 8973 = 0", "n % 6462 = 0", 99_975)],
)
def test_conditional_breakpoints(spark, limit, workers, first, second, left):
    good, bad = breakpoints.split(generate(spark, limit, workers), first)
    good2, bad2 = breakpoints.split(good, second)
    assert good2.count() == left
    assert left + bad.count() + bad2.count() == limit


def test_breakpoint_keeps_rows_it_cannot_judge(spark, rows):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert rows(breakpoints.split(df, "n > 0")[0]) == [(None,)]


def test_extremes_of_text(spark, rows):
    df = spark.createDataFrame([("a", "9"), ("a", "10"), ("a", None)], "k string, v string")
    for how, number, text in (("Max", "10.0", "9"), ("Min", "9.0", "10")):
        assert rows(R.group_by(df, 0, 1, how, as_text=True)) == [("a", number)]
        assert rows(R.group_by(df, 0, 1, how)) == [("a", text)]


def test_generator_waits_before_each_row(spark, rows):
    began = time.perf_counter()
    assert rows(generate(spark, 30, workers=3, delay=20)) == sorted((n,) for n in range(1, 11) for _ in range(3))
    assert time.perf_counter() - began >= 0.2
