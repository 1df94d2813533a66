"""A costly column that filters and other columns read is worked out once per row."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from respmosaic.catalog.base import fx_seq
from respmosaic.functions import words
from respmosaic.functions.text import computed, kmer_table
from respmosaic.operators import control, learning


def test_letters_of_a_document_are_kept_once(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["f5_make_item_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    lengths = fx_seq(spark, SF).select("item", F.length("seq").alias("n"), F.translate("seq", "GC", "").alias("rest")).filter("n > 3")
    assert lengths._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_computed_keeps_rows_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, "aXc", 5), (2, None, 6), (3, "", 7)], "a long, s string, b long")
    out = computed(rows, "s", F.upper("s"))
    assert out.columns == ["a", "s", "b"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "AXC", 5), (2, None, 6), (3, "", 7)]


@pytest.mark.parametrize("name", ["g3_stratum_profile", "g4_dataset_profile", "c25_formats"])
def test_a_profile_reads_its_rows_from_one_stored_table(spark, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(" not in plan


def counted(spark, rows, name, kind):
    """``rows`` with a column that passes through Python, and the number of values that did."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def same(x):
        seen.add(1)
        return x

    return computed(rows, name, same(name)), seen


def test_a_probe_reads_its_rows_once(spark):
    rows, seen = counted(spark, spark.createDataFrame([(i, [float(i % 7), float(i % 2)], i % 2) for i in range(90)], "row long, features array<double>, label int"), "features", "array<double>")
    rec = learning.linear_probe(rows.filter("row < 60"), rows.filter("row >= 60"), (1.0,), 3, 0)
    assert (rec["auc_test"], rec["n_train_raw"], rec["n_test_raw"], seen.value) == (1.0, 60, 30, 90)


def test_leave_one_out_reads_its_rows_once(spark):
    rows, seen = counted(spark, spark.createDataFrame([(i, [float(i % 2) + i / 1000], i % 2) for i in range(50)], "row long, features array<double>, label int"), "features", "array<double>")
    rec = learning.loo_classify(rows, (1.0,), max_rows=20)
    assert (rec["auc"], rec["n"], rec["n_fitted"], seen.value) == (1.0, 50, 20, 50)


def test_shuffled_controls_read_the_panel_once(spark):
    panel, seen = counted(spark, spark.createDataFrame([(i, "ab"[i % 2], "ACGT" * (i + 1)) for i in range(30)], "item long, stratum string, seq string"), "seq", "string")
    out = control.dinuc_shuffle(panel, 40, 1).select("probe_id", "length_bp", "source").collect()
    assert len({r["probe_id"] for r in out}) == 40 and seen.value == 30
    assert all(r["length_bp"] == 4 * (int(r["source"].split("::")[1]) + 1) for r in out)


def test_words_become_columns_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(words, "TEXTS", 2)
    texts = ["ACGT", None, "", "AAAAA", "acNAC", "ACAC", "G"]
    df = spark.createDataFrame(list(enumerate(texts)), "item long, seq string").coalesce(1)
    got = sorted(tuple(r) for r in kmer_table(df, ["item"], "seq", 2).collect())
    assert got == [(0, "AC", 1), (0, "CG", 1), (0, "GT", 1), (3, "AA", 4), (4, "AC", 1), (5, "AC", 2), (5, "CA", 1)]
