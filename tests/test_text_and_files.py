"""File formats, text functions, control sequences and scorers on small fixtures."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from respmosaic.functions import names, text
from respmosaic.operators import control, filters, integrity, learning, panel, scoring, splits, statistics
from respmosaic.sources import readers
from respmosaic.streaming import coverage


def one(df):
    return df.first()[0]


def test_fasta_junk_crlf_numbering_and_gzip(spark, tmp_path):
    import gzip

    body = "junk line\n>a|1\r\nACG\r\nTT\r\n\r\n>b|0\nGG\n>c\nNN\n"
    (tmp_path / "x.fa").write_text(body)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(">first\nAC\n>second\nGT\n")
    got = {(r["file"].split("/")[-1], r["row_idx"]): (r["header"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert got[("x.fa", 0)] == ("a|1", "ACGTT") and got[("x.fa", 1)] == ("b|0", "GG") and got[("x.fa", 2)] == ("c", "NN")
    assert got[("y.fa.gz", 0)] == ("first", "AC") and got[("y.fa.gz", 1)] == ("second", "GT") and len(got) == 5


def test_labelled_csv_and_policies(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sequence,label\n acgt ,1\nACGN,1\n,1\nGGGG,0\n")
    df = readers.read_labelled_csv(spark, str(tmp_path / "t.csv"))
    assert df.count() == 3
    kept = filters.filter_label_policy(df, "positive_only").filter(text.valid_sequence("seq"))
    assert [r["seq"] for r in kept.collect()] == ["acgt"]
    with pytest.raises(ValueError):
        filters.filter_label_policy(df, "nope")


def test_multilabel_headers(spark):
    df = spark.createDataFrame([("c:1-2_negative|1|1",), ("c:1-2_x|0|0",), ("c:3-4_y|0|1|1",)], "header string")
    rows = filters.filter_multilabel_any(df).collect()
    assert [(r["header"], r["label"]) for r in rows] == [("c:3-4_y|0|1|1", "1,2")]


def test_result_tree_tolerates_corrupt_files(spark, tmp_path):
    def put(entity, task, body):
        d = tmp_path / entity / task
        d.mkdir(parents=True)
        (d / "result.json").write_text(body)

    put("o__m", "t1", json.dumps({"auc_test": 0.75, "fit_params": {"n_cv": 5}}))
    put("o__m", "t2", json.dumps({"skip_reason": "tiny: n", "error_type": "tiny"}))
    put("o__n", "t1", "{broken")
    rows = readers.read_results(spark, str(tmp_path))
    got = {(r["entity"], r["task"]): r for r in rows.collect()}
    assert got[("o/m", "t1")]["auc"] == "0.75" and got[("o/m", "t1")]["readable"] and not got[("o/n", "t1")]["readable"]
    grid = {(r["entity"], r["task"]): r["auc"] for r in statistics.auc_matrix(rows).collect()}
    assert grid == {("o/m", "t1"): 0.75, ("o/m", "t2"): None, ("o/n", "t1"): None, ("o/n", "t2"): None}
    buckets = {r["bucket"]: r["n"] for r in integrity.outcome_buckets(rows, "entity").collect()}
    assert buckets == {"success": 1, "deliberate": 1, "corrupt": 1}


def test_listing_skips_twins_and_folders(spark, tmp_path):
    for name in ("a/x.csv", "a/x.csv.gz", "a/y.fa.gz", "Figures/z.csv", "README.csv", "b/n.json", "b/bad.fa"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    got = {r["path"] for r in readers.list_data_files(spark, str(tmp_path), blacklist=["b/bad.fa"]).collect()}
    assert got == {"a/x.csv", "a/y.fa.gz"}


def test_pairs_need_one_anchor(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b,derived\na,c,derived\na,d,other\na,e,other\n")
    assert readers.read_pairs_csv(spark, str(tmp_path / "p.csv")).count() == 4
    (tmp_path / "q.csv").write_text("a,b,x\nz,c,x\na,d,y\na,e,y\n")
    with pytest.raises(ValueError):
        readers.read_pairs_csv(spark, str(tmp_path / "q.csv"))


def test_feature_columns_must_be_dense(spark):
    assert readers.feature_columns(["embed_10", "label"] + [f"embed_{i}" for i in range(10)])[-1] == "embed_10"
    with pytest.raises(ValueError):
        readers.feature_columns(["embed_0", "embed_2"])
    df = spark.createDataFrame([(1.0, 2.0, 7)], "embed_1 double, embed_0 double, label int")
    assert readers.pack_features(df).first()["features"] == [2.0, 1.0]
    with pytest.raises(KeyError):
        readers.Catalog(spark, {"main": "x"}).load_panel("other")


def test_kmers_and_vectors(spark):
    df = spark.createDataFrame([(1, "AAAC"), (2, ""), (3, "ANAC"), (4, "G")], "item long, seq string")
    vec = {r[0]: r[1] for r in df.select("item", text.dinuc_vec("seq")).collect()}
    assert vec[1][0] == pytest.approx(2 / 3) and vec[1][1] == pytest.approx(1 / 3)
    assert vec[2] == [0.0] * 16 == vec[4] and vec[3][1] == 1.0
    table = {(r["item"], r["kmer"]): r["n"] for r in text.kmer_table(df, ["item"], "seq", 2).collect()}
    assert table == {(1, "AA"): 2, (1, "AC"): 1, (3, "AC"): 1}


def test_name_rules(spark):
    rows = [("org/dna_bert_6",), ("org/nucleotide-transformer-v2-50m-x",), ("evo-1-131k-base",), ("x/y-1.5b-300m",)]
    df = spark.createDataFrame(rows, "n string")
    got = df.select(names.family("n"), names.tokenizer_type("n"), names.infer_context("n"), names.extract_size("n"), names.organization("n")).collect()
    assert got[0][:2] == ("DNABERT", "overlapping_6mer") and got[1][0] == "NTv2" and got[1][3] == 50_000_000
    assert got[2][2] == 131_072 and got[2][4] == "arcinstitute" and got[3][3] == 1_500_000_000


def test_euler_shuffle_keeps_pairs_and_ends():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 400):
        s = "".join(rng.choice(list("ACGT"), n))
        t = control.euler_shuffle(s, np.random.default_rng(n))
        assert len(t) == len(s) and t[:1] == s[:1] and t[-1:] == s[-1:]
        assert Counter(zip(t, t[1:])) == Counter(zip(s, s[1:]))
    s = "ACGTTGCA" * 20
    assert len({control.euler_shuffle(s, np.random.default_rng(i)) for i in range(5)}) == 5


def test_control_panel_contract(spark):
    rows = [(i, f"s{i % 3}", "ACGTACGGTTAC" * 20) for i in range(9)]
    df = spark.createDataFrame(rows, "item long, stratum string, seq string")
    out = control.build_control_panel(df, 1, 35, 20, 40).toPandas()
    assert out["functional_element"].value_counts().to_dict() == {"ctrl_random_ACGT": 35, "ctrl_dinuc_shuffled": 20, "ctrl_motif_spiked": 40}
    assert list(out.columns) == "probe_id sequence length_bp functional_element species_group species GC_content dinuc_vec trinuc_vec source label_source".split()
    spiked = out[out.functional_element == "ctrl_motif_spiked"]
    for _, r in spiked.iterrows():
        motif = r["source"].split("motif=")[1].split("::")[0]
        mid = (r["length_bp"] - len(motif)) // 2
        assert r["sequence"][mid : mid + len(motif)] == motif
    random = out[out.functional_element == "ctrl_random_ACGT"]
    assert random["length_bp"].isin([200, 300, 500, 1000]).all() and (random["sequence"].str.len() == random["length_bp"]).all()
    assert random["GC_content"].min() < 0.3 and random["GC_content"].max() > 0.7


def test_ar_arithmetic(spark):
    model = spark.createDataFrame([("m", c, n, -1.2) for c in "ACGT" for n in "ACGT"], "entity string, ctx string, next string, logp double")
    out = scoring.score_ar(model, spark.createDataFrame([(1, "ACGTACGT"), (2, "")], "item long, seq string"), 1).collect()
    assert len(out) == 1
    r = out[0]
    assert r["sum_log_p"] == pytest.approx(-8.4) and r["predictable_tokens"] == 7 and r["ell_per_base"] == pytest.approx(-1.05)
    assert r["bpb"] == pytest.approx(1.05 / math.log(2)) and r["ce_loss"] == pytest.approx(1.2)


def test_pll_does_not_depend_on_stride(spark):
    seqs = spark.createDataFrame([("m", "ACGTACGGTAC"), ("m", "GGTACA"), ("n", "TTTT")], "entity string, seq string")
    panel_ = spark.createDataFrame([(1, "ACGTTA", 3), (2, "G", 1)], "item long, seq string, n int")
    model = scoring.fit_masked(seqs)
    runs = [{(r["entity"], r["item"]): r for r in scoring.score_pll(model, panel_, k).collect()} for k in (1, 6)]
    assert all(runs[0][k]["sum_log_p"] == pytest.approx(runs[1][k]["sum_log_p"]) for k in runs[0]) and len(runs[0]) == 4
    assert runs[0][("m", 1)]["n_passes"] == 6 and runs[1][("m", 2)]["n_passes"] == 1
    part = {(r["entity"], r["item"]): r for r in scoring.score_pll(model, panel_, 6, "n").collect()}
    assert part[("m", 1)]["content_position_count"] == 3 and part[("m", 1)]["sum_log_p"] > runs[0][("m", 1)]["sum_log_p"]
    with pytest.raises(ValueError):
        scoring.score_pll(model, panel_, 0)


def test_embed_split_fills_failures_and_rejects_mixed_sizes(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 1, None)], "id long, y int, v array<double>")
    assert scoring.embed_split(df, F.col("v"), "id", "y").orderBy("id").collect()[1]["features"] == [None, None]
    bad = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [1.0, 2.0])], "id long, y int, v array<double>")
    with pytest.raises(Exception, match="one size"):
        scoring.embed_split(bad, F.col("v"), "id", "y").collect()


def test_balanced_quota(spark):
    rows = [(i, "d", "a" if i < 50 else "b" if i < 53 else "c") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, lab string")
    for n, want in ((8, None), (13, {"a": 5, "b": 3, "c": 5}), (100, {"a": 50, "b": 3, "c": 7})):
        got = {r["lab"]: r["count"] for r in panel.sample_balanced(df, ["g"], "lab", "id", 5, n, 1).groupBy("lab").count().collect()}
        assert sum(got.values()) == min(n, 60) and (want is None or got == want)


def test_group_folds_are_disjoint(spark):
    ids = spark.createDataFrame([(i, "big" if i < 30 else f"g{i % 7}") for i in range(60)], "id long, grp string")
    folds = splits.group_kfold(ids, "id", "grp", 3, 1).toPandas()
    assert folds.groupby("grp")["fold"].nunique().max() == 1 and len(folds) == 60
    with pytest.raises(ValueError):
        splits.group_kfold(ids, "id", "grp", 20, 1).collect()


def test_runs_of_equal_size_are_placed_as_one_by_one():
    rng = np.random.default_rng(11)
    for _ in range(60):
        folds = int(rng.integers(2, 6))
        sizes = sorted(set(rng.integers(1, 40, rng.integers(1, 6)).tolist()), reverse=True)
        runs = [(n, int(rng.integers(1, 30))) for n in sizes]
        loads, want = [0] * folds, []
        for n, m in runs:
            for _ in range(m):
                at = min(range(folds), key=lambda i: (loads[i], i))
                loads[at] += n
                want.append(at)
        got = []
        for (n, before), (_, m) in zip(splits.size_runs(runs, folds), runs):
            k, before = np.arange(1, m + 1), np.array(before)
            got += (splits._level(before, n, k) - splits._level(before, n, k - 1)).argmax(1).tolist()
        assert got == want


def test_halves_in_steps_are_the_halves(spark):
    panel = spark.createDataFrame([(i, f"s{i * i % 23}") for i in range(300)], "item long, stratum string")
    whole, steps = (sorted(tuple(r) for r in splits.disjoint_halves(panel, [1, 2], chunk=c).collect()) for c in (None, 4))
    assert whole == steps and len(whole) == 600


def test_probe_finds_a_separable_class_and_reports_gates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3) + 2 * (i % 2)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "row long, features array<double>, label int")
    rec = learning.linear_probe(df.filter("row < 60"), df.filter("row >= 60"), (1.0,), 3, 0)
    assert rec["auc_test"] > 0.9 and rec["n_train"] == 60 and rec["n_classes"] == 2
    assert learning.linear_probe(df.filter("row < 10"), df.filter("row >= 60"))["error_type"] == "tiny"


def test_stream_state_only_moves_forward(spark, tmp_path):
    """Three batches: parts of the items, a late file that repeats cells, and one with a foreign item and a cell given twice."""
    items = spark.createDataFrame([(i,) for i in range(4)], "item long")
    rows = spark.createDataFrame([("a", i, 1.0) for i in range(4)] + [("b", 0, None), ("b", 9, 1.0), ("b", 1, 1.0), ("b", 1, 2.0)], "entity string, item long, value double")
    args = [str(tmp_path / p) for p in ("in", "store", "cp")]
    seen = []
    for part in ("item < 2 and entity = 'a'", "item >= 1 and entity = 'a'", "entity = 'b'"):
        rows.filter(part).write.mode("append").parquet(args[0])
        coverage.run_stream_coverage(spark, *args, items).awaitTermination()
        seen.append({r["entity"]: (r["state"], r["reason"], r["n_finite"]) for r in coverage.stream_coverage(spark, args[1], items).collect()})
    done = ("DONE", "", 4)
    assert seen == [{"a": ("PARTIAL", "row count", 2)}, {"a": done}, {"a": done, "b": ("PARTIAL", "duplicate items", 1)}]
    assert spark.read.parquet(args[1]).where("batch = 2").count() == 1  # only what a batch touched is written
    coverage.run_stream_coverage(spark, *args, items).awaitTermination()  # nothing new
    assert {r["entity"]: r["state"] for r in coverage.stream_coverage(spark, args[1], items).collect()} == {"a": "DONE", "b": "PARTIAL"}


def test_text_tree_is_the_tree_of_spark_without_its_file_system(spark, tmp_path):
    from respmosaic.sources import sinks

    ids = ["plain", "a/b", "100%", "ü x", "k=v", "[1]", "", None]
    cells = [(e, t, f"{i}{j}") for i, e in enumerate(ids) for j, t in enumerate(ids)]
    rows = spark.createDataFrame([*cells, ("plain", "k=v", "again"), ("plain", "a/b", None)], "entity string, task string, value string")
    rows.write.partitionBy("entity", "task").text(f"{tmp_path}/spark")
    sinks.write_text_tree(rows, f"file:{tmp_path}/own", ["entity", "task"])
    lines = {}
    for n in ("spark", "own"):
        lines[n] = sorted((str(p.parent.relative_to(tmp_path / n)), x) for p in (tmp_path / n).rglob("part-*") for x in p.read_text().splitlines())
    assert lines["own"] == lines["spark"] and len(lines["own"]) == 66
    # Hadoop's local file system would have left a check sum beside each file.
    assert not [p for p in (tmp_path / "own").rglob("*") if p.is_file() and not p.name.startswith("part-")]
    one = rows.filter("entity in ('plain', 'a/b') and task in ('ü x', '100%')")
    sinks.write_text_tree(one.withColumn("value", F.concat(F.lit('{"auc_test": "'), "value", F.lit('"}'))), f"file:{tmp_path}/some", ["entity", "task"])
    got = {(r["task"], r["auc"]) for r in readers.read_results(spark, f"{tmp_path}/some", "part-*").collect()}
    assert {a for _, a in got} == {"02", "03", "12", "13"}
