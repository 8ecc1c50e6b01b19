"""Text sources and sinks, edge cases of series operators, and the stream."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timescale import StepFunction
from tidemark.operators import predictive, series
from tidemark.sources import text
from tidemark.sources.tables import event_series, series_of
from tidemark.plans import sampled

SF = "/root/testdata/sf0.001"


def test_series_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2.5 3 x 9\n")
    (tmp_path / "b.txt").write_text("\n4\n5 6\n")
    (tmp_path / "empty.txt").write_text("\n")
    (tmp_path / "list.txt").write_text("a.txt\nb.txt\nempty.txt\n")
    m = text.read_manifest(spark, str(tmp_path / "list.txt"), str(tmp_path))
    got = sorted(map(tuple, text.read_manifest_series(spark, m).collect()))
    assert got == [("a", 0, 1.0), ("a", 1, 2.5), ("a", 2, 3.0), ("b", 0, 4.0), ("b", 1, 5.0), ("b", 2, 6.0)]
    assert {r["series"] for r in m.collect()} == {"a", "b", "empty"}
    assert text.read_series(spark, str(tmp_path / "b.txt"), line_per_series=True).select("series").distinct().count() == 2
    assert [tuple(r) for r in text.read_matrix(spark, str(tmp_path / "b.txt"), 1, 2).orderBy("col").collect()] == [(0, 0, 4.0), (0, 1, 5.0)]
    assert text.read_step_function(spark, str(tmp_path / "empty.txt"), 1.0) is None


def test_step_function_and_histogram_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("0 1\n0.5 2\n")
    assert text.read_step_function(spark, str(tmp_path / "s.txt"), 1.0) == StepFunction((0.0, 0.5), (1.0, 2.0), 1.0)
    (tmp_path / "h.txt").write_text("3 1 2\n5\n")
    assert sorted((r["n"], r["bins"]) for r in text.read_histogram(spark, str(tmp_path / "h.txt")).collect()) == [(3.0, [1, 2]), (5.0, [])]
    (tmp_path / "n.txt").write_text("10 20\n")
    assert [tuple(r) for r in text.read_sample_sizes(spark, str(tmp_path / "n.txt")).orderBy("interval").collect()] == [(0, 10), (1, 20)]
    text.write_text(spark.createDataFrame([("a", [0.5, 1.0], 2)], "s string, theta array<double>, k int"), str(tmp_path / "out"), 2)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a 0.50 1.00 2"]


def test_dense_histogram_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("0\n2\n0\n1\n0\n0\n0\n0\n4\n")
    got = text.read_dense_histogram(spark, str(tmp_path / "d.txt"), 3, 2)
    assert sorted((r["bins"], r["n"]) for r in got.collect()) == [([0, 1], 1.0), ([1, 0], 2.0), ([2, 2], 4.0)]
    text.write_dense_histogram(got.withColumn("n", F.col("n").cast("long")), str(tmp_path / "out"), 3, 2)
    parts = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert parts == (tmp_path / "d.txt").read_text()
    with pytest.raises(Exception, match="outside of the cells"):
        text.write_dense_histogram(spark.createDataFrame([([3, 0], 1)], "bins array<int>, n long"), str(tmp_path / "bad"), 3, 2)


def test_lines_by_place(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.25), ("b", 0, 1.0), ("a", 1, 2.0), ("a", 1, 1.0), ("c", None, 9.0), ("c", 7, 1.0), ("d", 0, None)], "s string, i int, v double")
    assert sorted(map(tuple, text.lines(df, "s", "i", "v", 3, 2).collect())) == [("a", "0 2.00 0"), ("b", "1.00 0 0.25"), ("d", "0 0 0")]
    assert ("b", "1.00 0.25") in set(map(tuple, text.lines(df, "s", "i", "v", digits=2).collect()))
    text.write_lines(text.lines(df, "s", "i", "v", 3, 2), str(tmp_path / "out"), "s")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "0 2.00 0\n1.00 0 0.25\n0 0 0\n"
    assert text.lines(df.limit(0), "s", "i", "v", 3).count() == 0


def test_simulators(spark):
    assert abs(text.simulate_counts(spark, 2000, [1000], [1, 5], 3).where("seq >= 1000").agg(F.avg("n")).first()[0] - 5) < 0.4
    p = text.simulate_process(spark, 100.0, 10.0, [50.0], [1.0, 0.2], 3)
    assert 350 < p.where("t < 50").count() < 650 and 40 < p.where("t >= 50").count() < 180


def test_ties_and_bounds(spark):
    ev = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0)], "series string, t double")
    probes = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("empty", 1.0)], "series string, t double")
    assert sorted((r["series"], r["t"], r["idx"]) for r in series.count_before(ev, probes, 0.5).collect()) == [("a", 1.0, 0), ("a", 2.0, 2), ("a", 3.0, 3), ("empty", 1.0, 0)]
    assert sorted(r["idx"] for r in series.count_before(ev, probes, 0.5, inclusive=True).collect()) == [0, 2, 3, 3]
    s = StepFunction((0.0, 0.5), (1.0, 2.0), 1.0)
    got = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (1.5,)], "t double").select(s.value(F.col("t")), s.integral(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.5), (2.0, 1.5), (1.0, 3.0), (2.0, 2.0)]


def test_stream_equals_replay(spark):
    got = {(r["series"], r["win"]): (r["r"], r["shape"], r["rate"]) for r in sampled.stream_pvalues(spark, SF).collect()}
    ev = event_series(spark, SF)
    want = {(r["series"], r["win"]): (r["r"], r["shape"], r["rate"]) for r in predictive.sequential(predictive.windows_of(ev, series_of(ev), 0.0, 30, 1.0), 1.0, 1.0, 1.0).collect()}
    assert len(got) > 100 and all(want[k] == v for k, v in got.items())
