import math

import pytest
from pyspark.sql import functions as F

from doubtline.functions import prob as P
from doubtline.functions import vectors as V
from doubtline.functions.hashing import hash_uniform, md5_uniform, uniform_text
from doubtline.functions.student import t_quantile


@pytest.mark.parametrize(
    "p, df, want",
    [(0.975, 1, 12.7062047362), (0.975, 10, 2.2281388520), (0.95, 30, 1.6972608865), (0.95, 9999, 1.6450060333)],
)
def test_student_quantile(p, df, want):
    assert t_quantile(p, df) == pytest.approx(want, abs=1e-9)
    assert t_quantile(1 - p, df) == pytest.approx(-want, abs=1e-9)


def test_student_quantile_edges():
    assert math.isnan(t_quantile(0.9, 0))
    assert t_quantile(0.5, 7) == 0.0
    below, above = t_quantile(0.95, 99_999), t_quantile(0.95, 100_001)
    assert below == pytest.approx(above, abs=1e-9)


def prob_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.2, 0.8]), (3, [0.0, 0.0, 1.0]), (4, [1 / 3] * 3)]
    return spark.createDataFrame(rows, "i int, prob array<double>")


def test_certainty_by_hand(spark):
    got = {r.i: r.u for r in prob_rows(spark).select("i", P.certainty("prob", 2).alias("u")).collect()}
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.0, abs=1e-12)
    assert got[2] == pytest.approx(1 - 0.721928094887)
    assert got[3] == pytest.approx(1.0)
    assert got[4] == pytest.approx(1 - math.log2(3))  # more classes than the norm: below zero


def test_unrolled_certainty_equals_general(spark):
    df = prob_rows(spark).filter("size(prob) = 2")
    rows = df.select(P.certainty("prob", 2).alias("a"), P.certainty("prob", 2, 2).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-12) for r in rows)


def test_argmax_takes_the_first_on_ties(spark):
    got = {r.i: r.p for r in prob_rows(spark).select("i", P.argmax("prob").alias("p")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 0}


def test_votes(spark):
    df = spark.createDataFrame([(0, [2, 1, 1]), (1, [0, 1, 2]), (2, [3, 3, 3])], "i int, v array<int>")
    got = {r.i: (r.m, r.s) for r in df.select("i", P.modal_vote("v").alias("m"), P.vote_share("v").alias("s")).collect()}
    assert got[0] == (1, pytest.approx(2 / 3))
    assert got[1] == (0, pytest.approx(1 / 3))  # the smallest on ties
    assert got[2] == (3, 1.0)


def test_paired_probability(spark):
    df = spark.createDataFrame([([0.9, 0.1], 1), ([0.2, 0.8], 1), ([0.3, 0.7], 0)], "prob array<double>, pred int")
    got = [r.q for r in df.select(P.paired_probability("prob", "pred").alias("q")).collect()]
    assert got == [[0.1, 0.9], [0.2, 0.8], [0.7, 0.3]]


def test_cleaning(spark):
    bad = [1.5, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(bad,)], "x array<double>").select(V.clean_vector("x").alias("x"))
    assert df.first().x == [1.5, 0.0, 0.0, 0.0, 0.0]
    one = spark.createDataFrame([(b,) for b in bad], "x double")
    assert [r[0] for r in one.select(V.clean_measure("x")).collect()] == [1.5, -10.0, -10.0, -10.0, -10.0]
    assert [r[0] for r in one.select(V.clean_judge_input("x")).collect()] == [1.5, 0.0, V.DOUBLE_MAX, -V.DOUBLE_MAX, 0.0]


def test_share_inside_with_missing_bounds(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0, 3.0, 9.0], [0.0, math.nan, 3.0, 0.0], [2.0, math.nan, 3.0, 8.0])],
        "x array<double>, lo array<double>, hi array<double>",
    )
    row = df.select(V.share_inside("x", "lo", "hi", 4).alias("a"), V.share_inside("x", "lo", "hi").alias("b")).first()
    assert row.a == row.b == 0.5


def test_distances_unrolled_and_general(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(
        V.euclidean("a", "b", 2).alias("e"), V.euclidean("a", "b").alias("f"),
        V.mean_absolute_error("a", "b", 2).alias("m"), V.mean_absolute_error("a", "b").alias("n"),
    ).first()
    assert (row.e, row.f, row.m, row.n) == (5.0, 5.0, 3.5, 3.5)


def test_uniforms_are_uniform_and_keyed(spark):
    df = spark.range(20000).select(md5_uniform(1, F.col("id")).alias("a"), hash_uniform(1, F.col("id")).alias("b"))
    row = df.agg(F.avg("a"), F.avg("b"), F.min("a"), F.max("b"), F.countDistinct("b")).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(0.5, abs=0.01)
    assert row[2] >= 0 and row[3] < 1 and row[4] == 20000
    same = spark.range(100).filter(
        (md5_uniform(1, F.col("id")) != F.expr(uniform_text("md5", "1", "id")))
        | (hash_uniform(1, F.col("id")) != F.expr(uniform_text("xxhash", "1", "id")))
    )
    assert same.count() == 0


def test_null_vectors_are_missing_values():
    import pyarrow as pa

    column = pa.array([[1.0, 2.0], None, [3.0, 4.0], None], pa.list_(pa.float64()))
    assert V.to_matrix(column).tolist() == [[1, 2], [0, 0], [3, 4], [0, 0]]
    assert V.to_matrix(column.slice(1, 2)).tolist() == [[0, 0], [3, 4]]
    assert V.to_matrix(pa.array([None], pa.list_(pa.float64()))).tolist() == [[0.0]]
    with pytest.raises(ValueError):
        V.to_matrix(pa.array([[1.0], [1.0, 2.0, 3.0]], pa.list_(pa.float64())))
