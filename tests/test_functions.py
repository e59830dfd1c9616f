"""Skew-safe building blocks against plain windows and brute force."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.functions.ordered import PIECE, previous, row_numbers, running_sums, with_piece
from evigrid.functions.quantiles import exact_quantiles
from evigrid.functions.scalars import close_to, normal_cdf, normal_quantile, relative_delta_pct


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; values repeat and cover both signs, zero and several magnitudes."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 17}"
        value = rng.choice([0.0, -0.0, 1.5, -2.25, rng.gauss(0, 1), rng.gauss(0, 1e6), rng.gauss(0, 1e-6)])
        rows.append((key, i, rng.randrange(100000), value))
    return spark.createDataFrame(rows, "k string, id bigint, t bigint, v double").persist()


def test_chunked_order_equals_plain_window(skewed):
    order, chunk = [F.col("t"), F.col("id")], F.floor(F.col("t") / 1000)
    w = W.partitionBy("k").orderBy(*order)
    got = running_sums(skewed, ["k"], order, chunk, {"s": F.col("id"), "at": F.lit(1).cast("bigint")}, totals=True)
    want = skewed.select(
        "k", "id", F.sum("id").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).cast("bigint").alias("at"),
        F.sum("id").over(W.partitionBy("k")).alias("s_total"),
    )
    assert got.select("k", "id", "s", "at", "s_total").exceptAll(want).isEmpty()
    lagged = previous(skewed, ["k"], order, chunk, {"pt": "t", "pv": "v"})
    plain = skewed.select("k", "id", F.lag("t").over(w).alias("pt"), F.lag("v").over(w).alias("pv"))
    assert lagged.select("k", "id", "pt", "pv").exceptAll(plain).isEmpty()


def test_pieces_keep_order(skewed):
    rows = with_piece(skewed, "v", "id").select("v", "id", PIECE).orderBy("v", "id").collect()
    assert all(a[PIECE] <= b[PIECE] for a, b in zip(rows, rows[1:], strict=False))
    assert len({r[PIECE] for r in rows}) > 100


@pytest.mark.parametrize("rule", ["linear", "rank"])
def test_quantiles_equal_definition(skewed, rule):
    probabilities = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 0.975, "f": 1.0}
    got = {r["k"]: r for r in exact_quantiles(skewed, ["k"], "v", probabilities, rule).collect()}
    bounded = {r["k"]: r for r in exact_quantiles(skewed, ["k"], "v", probabilities, rule, bounded=True).collect()}
    values = {}
    for r in skewed.collect():
        values.setdefault(r["k"], []).append(r["v"])
    assert got.keys() == values.keys()
    for key, data in values.items():
        data.sort()
        for name, p in probabilities.items():
            if rule == "linear":
                at = (len(data) - 1) * p
                lo, hi = math.floor(at), math.ceil(at)
                want = data[lo] * (1 - (at - lo)) + data[hi] * (at - lo)
            else:
                want = data[max(math.ceil(p * len(data) - 1e-9), 1) - 1]
            assert math.isclose(got[key][name], want, rel_tol=1e-12, abs_tol=1e-15), (key, name)
            assert math.isclose(bounded[key][name], want, rel_tol=1e-12, abs_tol=1e-15), (key, name)


def test_small_quantiles(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "k int, v double")
    assert math.isclose(exact_quantiles(df, ["k"], "v", {"q": 0.9}).first()["q"], 3.7)
    assert exact_quantiles(df, ["k"], "v", {"q": 0.9}, "rank").first()["q"] == 4
    assert exact_quantiles(df, ["k"], "v", {"q": 0.5}).first()["q"] == 2.5


def test_infinite_values_stay_infinite(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, float("inf")), (1, 0.0)], "k int, v double")
    assert exact_quantiles(df, ["k"], "v", {"q": 0.75}).first()["q"] == float("inf")


def test_fingerprint_depends_on_order(spark):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "y"), ("c", 0, "y"), ("c", 1, "x"), ("d", 0, "x")]
    df = spark.createDataFrame(rows, "s string, i int, v string")
    got = dict(df.groupBy("s").agg(sequence_fingerprint(element_digest("i", "v")).alias("f")).collect())
    assert got["a"] == got["b"] and len({got["a"], got["c"], got["d"]}) == 3


def test_scalars(spark):
    row = spark.range(1).select(
        relative_delta_pct(F.lit(3.0), F.lit(2.0)).alias("a"), relative_delta_pct(F.lit(3.0), F.lit(0.0)).alias("b"),
        close_to(F.lit(1.0), F.lit(1.0 + 1e-12)).alias("c"), normal_cdf(F.lit(1.96)).alias("d"), normal_quantile(F.lit(0.975)).alias("e"),
        normal_quantile(F.lit(1.0)).alias("f"),
    ).first()
    assert row["a"] == 50 and row["b"] is None and row["c"]
    assert abs(row["d"] - 0.9750021) < 1e-6 and abs(row["e"] - 1.959964) < 1e-6 and row["f"] is None


def test_normal_columns_equal_the_distribution(spark):
    from statistics import NormalDist

    normal = NormalDist()
    xs = [i / 8 for i in range(-80, 81)] + [-30.0, 30.0, float("inf"), float("-inf"), 2.5, 1e-300]
    for x, got in spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf("x")).collect():
        assert abs(got - normal.cdf(x)) < 1e-13
        assert x > -2 or x < -30 or got == pytest.approx(math.erfc(-x / math.sqrt(2)) / 2, rel=1e-12)
    ps = [i / 97 for i in range(1, 97)] + [0.5, 1e-9, 1e-15, 1 - 1e-9, 0.025, 0.975]
    for p, got in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile("p")).collect():
        assert got == pytest.approx(normal.inv_cdf(p), rel=1e-11, abs=1e-12)
    edges = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,), (float("nan"),)], "p double")
    assert [r[0] for r in edges.select(normal_quantile("p")).collect()] == [None] * 5
    assert [r[0] for r in edges.where("p is null or isnan(p)").select(normal_cdf("p")).collect()] == [None] * 2
