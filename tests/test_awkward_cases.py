"""Cases that fixtures and SQL written from the same constants cannot show."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respmosaic.catalog import gate_queries
from respmosaic.functions import names, text, words
from respmosaic.operators import distance
from respmosaic.sources import readers, sinks
from respmosaic.streaming import coverage

FAMILIES = {
    "InstaDeepAI/agro-nucleotide-transformer-1b": "AgroNT", "zhihan1996/DNABERT-S": "DNABERT-S", "zhihan1996/DNABERT-2-117M": "DNABERT-2", "x/dnabert2-small": "DNABERT-2", "armheb/DNA_bert_6": "DNABERT",
    "x/dnabert": "DNABERT", "InstaDeepAI/NTv3_generative": "NTv3", "InstaDeepAI/nucleotide-transformer-v2-50m": "NTv2", "InstaDeepAI/nucleotide-transformer-500m": "NT", "AIRI/gena-lm-bert": "GENA-LM",
    "AIRI/moderngena-base": "ModernGENA", "PoetschLab/GROVER": "GROVER", "LongSafari/hyenadna-tiny": "HyenaDNA", "k/PlantCAD2": "PlantCaduceus", "k/caduceus-ph": "Caduceus", "x/PlantBiMoE": "PlantBiMoE",
    "arcinstitute/evo2_7b": "Evo2", "arc/evo-2-7b": "Evo2", "togethercomputer/evo-1-8k-base": "Evo1", "evo-design/evo-1.5-8k": "Evo1", "lingxusb/megaDNA_updated": "MegaDNA", "x/generator-v2-3b": "GENERator",
    "GenerTeam/GENERator-eukaryote": "GENERator", "GenerTeam/GENERanno-prok": "GENERanno", "HuggingFaceBio/carbon-3b": "Carbon", "lingxusb/plasmidgpt": "PlasmidGPT", "pGenomeOcean/GenomeOcean-4B": "GenomeOcean",
    "BGI/Genos-1.2B": "Genos", "x/OneGenome-7b": "OneGenome", "genbio-ai/AIDO.DNA-7B": "AIDO.DNA", "x/hybridna-300m": "HybriDNA", "x/botanic0-s": "Botanic0", "R/Mistral-DNA-v1": "Mistral-DNA",
    "x/ModernBERT-DNA-37M": "ModernBERT-DNA", "x/Jamba-DNA-114M": "Jamba-DNA", "x/genslm-25m": "GenSLM", "owner/Other-1b": "Other",
}


def test_every_family_label(spark):
    df = spark.createDataFrame([(k,) for k in FAMILIES], "name string")
    assert {r["name"]: r["f"] for r in df.select("name", names.family("name").alias("f")).collect()} == FAMILIES


def test_json_keys_at_any_depth(spark):
    deep = '{"a":' * 40 + '{"n_positions": 7, "max_seq_len": true, "seq_length": 1e9}' + "}" * 40
    df = spark.createDataFrame([(1, deep), (2, "[[[{\"n_positions\": 3.9}]]]"), (3, "{broken"), (4, None)], "id int, doc string")
    assert {(r["id"], r["path"], r["found"]) for r in names.json_find_keys(df, "doc").collect()} == {(1, ".".join("a" * 40) + ".n_positions", 7), (2, "[0][0][0].n_positions", 3)}


def test_word_counts_of_any_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ACGTN"), rng.integers(0, 60), p=[0.24, 0.24, 0.24, 0.24, 0.04]))) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, seq string")
    for k in (1, 4, 5):
        got = {r["id"]: r["n"] for r in df.select("id", text.kmer_count_array("seq", k).alias("n")).collect()}
        table = {(r["id"], r["kmer"]): r["n"] for r in text.kmer_table(df, ["id"], "seq", k).collect()}
        order = text.kmer_names(k)
        for i, s in rows:
            want = {}
            for j in range(len(s or "") - k + 1):
                if "N" not in s[j : j + k]:
                    want[s[j : j + k]] = want.get(s[j : j + k], 0) + 1
            assert {w: n for w, n in zip(order, got[i]) if n} == want == {w: n for (d, w), n in table.items() if d == i}
    assert text.kmer_features(df, "id", "seq", 4, 4).where("feature = 'ACGT'").count() == len(rows)


def test_word_counts_across_parts(monkeypatch):
    monkeypatch.setattr(words, "PART", 7)
    s = "ACGTTACGGTéACGTACGT漢" * 5
    want = pd.Series([s[i : i + 3] for i in range(len(s) - 2)]).value_counts().to_dict()
    assert words.count_words(s, 3) == want
    dense = words.count_vector(s, 3, "ACGT")
    assert {w: n for w, n in zip(text.kmer_names(3), dense) if n} == {w: n for w, n in want.items() if set(w) <= set("ACGT")}


@pytest.mark.parametrize("level", [0.0, -1500.0, 1e8])
@pytest.mark.parametrize("holes", [False, True])
def test_near_duplicate_rows_keep_their_digits(long, level, holes):
    rng = np.random.default_rng(2)
    x = level + rng.normal(size=(6, 40))
    x[1] = x[0] + 1e-6 * (1 if level < 1e6 else 1e5)
    cells = x.tolist()
    if holes:
        cells[2][3] = None
        cells[0][5] = None
    got = {(r["entity_i"], r["entity_j"]): r["d"] for r in distance.pairwise_sq_distance(long(cells)).collect()}
    y = np.array([[np.nan if v is None else v for v in row] for row in cells])
    for (i, j), d in got.items():
        gap = y[i] - y[j]
        seen = ~np.isnan(gap)
        assert d == pytest.approx(float((gap[seen] ** 2).sum()) * 40 / seen.sum(), rel=1e-9)


def test_a_cell_that_occurs_twice_is_refused(spark):
    v = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 0, 3.0)], "entity long, item long, value double")
    with pytest.raises(Exception, match="twice"):
        distance.pairwise_sq_distance(v).collect()


def test_entities_stay_text(spark, tmp_path):
    scores = spark.createDataFrame([("007", 1, 0.5), ("7", 1, 1.5)], "entity string, item long, value double")
    sinks.write_scores(scores, str(tmp_path / "s"))
    assert {(r["entity"], r["value"]) for r in readers.read_scores(spark, str(tmp_path / "s")).collect()} == {("007", 0.5), ("7", 1.5)}


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sequence,label\n"AC\nGT",1\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect()] == [("AC\nGT", "1")]


def test_a_batch_that_repeats_a_cell_stays_visible(spark, tmp_path):
    items = spark.createDataFrame([(1,), (2,)], "item long").select(F.col("item"))
    folders = [str(tmp_path / p) for p in ("in", "store", "cp")]
    for cells in ([("a", 1, 0.5), ("a", 2, 0.5)], [("a", 1, 1.0), ("a", 1, 2.0)]):
        spark.createDataFrame(cells, "entity string, item long, value double").write.mode("append").parquet(folders[0])
        coverage.run_stream_coverage(spark, *folders, items).awaitTermination()
    last = spark.read.parquet(folders[1]).where("batch = 1").first()
    assert (last["n_rows"], last["n_distinct"], last["n_finite"]) == (3, 2, 2)
    assert tuple(coverage.stream_coverage(spark, folders[1], items).first())[1:3] == ("PARTIAL", "duplicate items")


@pytest.mark.parametrize("head", ["", "junk before the first record\n"])
def test_fasta_records_are_numbered_across_blocks(spark, tmp_path, head):
    records = [(f"id{i}|x", "ACGT" * (i % 7 + 1)) for i in range(200)]
    (tmp_path / "a.fa").write_text(head + "".join(f">{h}\n{s}\n" for h, s in records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["header"], r["seq"]) for r in sorted(rows, key=lambda r: r["row_idx"])] == records
    assert sorted(r["row_idx"] for r in rows) == list(range(200))


def test_rows_without_a_sequence_do_not_come_back_from_the_table(spark, tmp_path):
    spark.createDataFrame([(1, "acgt", "en", "s"), (2, "xyz", "en", "s"), (3, "", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in gate_queries.s2(spark, str(tmp_path)).collect()] == [("ACGT", "1")]


def test_result_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gate_queries, "scratch", lambda spark: str(tmp_path / "tree"))
    rows = gate_queries.s6_tree(spark, "/root/testdata/sf0.001").count()
    files = [p.name.split("-")[1] for p in (tmp_path / "tree").rglob("part-*")]
    assert len(files) == rows and len(set(files)) > 1
