"""Ranks, quantiles and correlations against brute force, with one value holding a third."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respmosaic.operators.statistics import roc_auc
from respmosaic.plans import quantiles, ranking
from respmosaic.plans.correlation import spearman
from respmosaic.plans.ranking import average_rank, hash_rank, ordered_rank


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(5)
    n = 3000
    value = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.normal(size=n), 3))
    pdf = pd.DataFrame({"k": np.arange(n), "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 5, n).astype(str)), "x": value, "y": rng.integers(0, 2, n)})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_exact_quantiles_by_group(hot, monkeypatch):
    monkeypatch.setattr(quantiles, "WHOLE", 100)
    pdf, df = hot
    got = {(r["g"], r["q"]): r["quantile"] for r in quantiles.exact_quantiles(df, "x", [0.0, 0.02, 0.5, 1.0], ["g"], accuracy=200).collect()}
    for g, part in pdf.groupby("g"):
        for q in (0.0, 0.02, 0.5, 1.0):
            assert got[(g, q)] == pytest.approx(np.quantile(part["x"], q), abs=1e-12)


def test_exact_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (4.0,)], "x double")
    assert quantiles.exact_quantiles(df, "x", [0.5]).first()["quantile"] == 2.5


def test_ordered_rank_splits_a_hot_value(hot):
    pdf, df = hot
    got = {r["k"]: r["rank"] for r in ordered_rank(df, [], [("x", "desc"), ("k", "asc")]).collect()}
    want = pdf.sort_values(["x", "k"], ascending=[False, True])["k"].tolist()
    assert [got[k] for k in want] == list(range(1, len(want) + 1))


def test_ordered_rank_text_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("abcdefgh",), ("abcdefga",), (None,), ("",), ("ü",)], "s string")
    got = [r["s"] for r in ordered_rank(df, [], [("s", "asc")]).orderBy("rank").collect()]
    assert got == ["", "abcdefga", "abcdefgh", "b", "ü", None]


def test_ordered_rank_text_first_with_a_shared_prefix(spark):
    rows = [(f"Customer#{i % 50:06d}", (i * 7) % 13, i) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, t int, k int")
    got = [r["k"] for r in ordered_rank(df, [], [("s", "asc"), ("t", "desc"), ("k", "asc")]).orderBy("rank").collect()]
    assert got == [k for _, _, k in sorted(rows, key=lambda r: (r[0], -r[1], r[2]))]


def test_ordered_rank_long_values_beyond_double_precision(spark):
    base = 2**60
    rows = [(base + i, -i) for i in range(150)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    assert [r["a"] - base for r in ordered_rank(df, [], [("a", "asc"), ("b", "asc")]).orderBy("rank").collect()] == list(range(150))


def test_hash_rank_is_a_permutation_per_group(hot):
    pdf, df = hot
    ranked = hash_rank(df, ["g"], 1, ["k"]).toPandas()
    for g, part in ranked.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_average_rank_and_spearman(hot):
    pdf, df = hot
    got = average_rank(df, "x").toPandas().set_index("k")["rank"].sort_index()
    assert np.allclose(got, pdf.set_index("k")["x"].rank())
    rho = spearman(df, "x", "y").first()["spearman"]
    assert rho == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))


def test_roc_auc_brute_force(hot):
    pdf, df = hot
    pos, neg = pdf[pdf.y == 1]["x"].to_numpy(), pdf[pdf.y == 0]["x"].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert roc_auc(df, "x", "y").first()["auc"] == pytest.approx(want)
    assert roc_auc(df.filter("y = 1"), "x", "y").first()["auc"] is None


@pytest.mark.parametrize("n", [3_000, 24_000])
@pytest.mark.parametrize("order", ["number", "day", "name", "flag"])
def test_ranges_are_bounded_at_any_size(spark, n, order):
    """The same bound holds at both sizes, for texts, dates, numbers and flags; a third of the rows tie on the first column, and rows repeat."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("number"),
        F.when(F.col("id") % 3 == 0, F.lit("chromosome_hot")).otherwise(F.format_string("chromosome_%07d", F.col("id") % 500)).alias("name"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("int")).alias("day"),
        (F.col("id") % 3 == 0).alias("flag"),
        F.floor(F.col("id") / 2).alias("tie"),
    )
    stored, sizes = ranking._ranged(rows, [F.col(order), F.col("tie")], rows=500)
    assert sizes.agg(F.max("_n")).first()[0] <= 500 and sizes.agg(F.sum("_n")).first()[0] == n
    ranked = ordered_rank(rows, [], [(order, "desc"), ("tie", "asc")], "r", rows=500).toPandas().sort_values("r")
    assert ranked["r"].tolist() == list(range(1, n + 1))
    want = rows.toPandas().sort_values("tie", kind="stable").sort_values(order, ascending=False, kind="stable")
    assert ranked[order].tolist() == want[order].tolist() and ranked["tie"].tolist() == want["tie"].tolist()


@pytest.mark.parametrize("tie", ["lower(g)", "to_date('2020-01-01') + cast(k as int)", "k * 2", "cast(k as double)", "k % 2 = 0"])
def test_rank_by_group_with_any_tie_break(hot, tie):
    pdf, df = hot
    got = ordered_rank(df.withColumn("t", F.expr(tie)), ["g"], [("y", "asc"), ("t", "desc"), ("k", "asc")], rows=200).toPandas()
    for _, part in got.groupby("g"):
        want = part.sort_values("k").sort_values("t", ascending=False, kind="stable").sort_values("y", kind="stable")
        assert want["rank"].tolist() == list(range(1, len(part) + 1))


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5), ("a", None)], "g string, x int")
    got = {(r["g"], r["x"]): r["rank"] for r in ordered_rank(df, ["g"], [("x", "asc")]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 5): 1, ("a", None): 2}
    assert ordered_rank(df.where("false"), ["g"], [("x", "asc")]).count() == 0


def test_quantiles_over_ranges(hot, monkeypatch):
    monkeypatch.setattr(quantiles, "ONE_WINDOW", 10)
    pdf, df = hot
    got = {(r["g"], r["q"]): r["quantile"] for r in quantiles.exact_quantiles(df, "x", [0.0, 0.3, 0.5, 1.0], ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for q in (0.0, 0.3, 0.5, 1.0):
            assert got[(g, q)] == pytest.approx(np.quantile(part["x"], q), abs=1e-12)


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_suppkey = 3").select("l_suppkey", "l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in plan and "l_comment" not in plan


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_text_ranks_with_a_hot_text(spark, direction):
    """Texts that share a long prefix, and one text that holds a third of the rows."""
    rows = [(f"chromosome_promoter_{i:06d}" if i % 3 else "chromosome_promoter_hot", i) for i in range(6000)] + [(None, 7), ("", 8)]
    df = spark.createDataFrame(rows, "name string, i long")
    ranked = ranking.ordered_rank(df, [], [("name", direction), ("i", "asc")], "r").collect()
    given = [r for r in rows if r[0] is not None]
    want = sorted(sorted(given, key=lambda r: r[1]), key=lambda r: r[0], reverse=direction == "desc") + [(None, 7)]
    assert [(r["name"], r["i"]) for r in sorted(ranked, key=lambda r: r["r"])] == want
