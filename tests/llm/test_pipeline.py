"""The pipeline's stages against brute force on the small documents."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import cases
from cases import docs, empty  # noqa: F401
import corpus_pipeline
from conftest import SF
from respmosaic.llm import bpe, secret_scan
from respmosaic.llm.storage import store


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), "test-stage")
        out.append(docs.collect())
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "byte-level BPE"]


def test_rejects_labelled_junk_and_keeps_the_rest(spark, stages):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    assert kept < {r["doc_id"] for r in stages[0]}
    good = [d for d, q in quality.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert all(r in stages[0] for r in stages[1])


def test_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1]]
    want = {d for d, _, c in cases.components(rows) if c == d}
    assert {r["doc_id"] for r in stages[2]} == want and all(r in stages[1] for r in stages[2])


def test_contaminated_documents_leave(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cases.ALNUM.findall(cases.lower(r["text"]))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    want = []
    for r in stages[2]:
        w, hit = cases.ALNUM.findall(cases.lower(r["text"])), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r)
    assert Counter(map(tuple, want)) == Counter(map(tuple, stages[3]))


def test_secrets_are_replaced_and_text_survives_tokens(spark, stages):
    before, after = ({r["doc_id"]: r for r in s} for s in stages[3:5])
    assert before.keys() == after.keys()
    found = {r["doc_id"] for r in secret_scan.find_secrets(spark.createDataFrame(stages[3])).where("size(secrets) > 0").collect()}
    assert {d for d in before if before[d]["text"] != after[d]["text"]} == found
    assert all("[SECRET]" in after[d]["text"] and after[d]["n_chars"] == len(after[d]["text"]) for d in found)
    voc = bpe.Vocabulary.load(*bpe.default_vocabulary())
    assert all(r["round_trip"] and r["ids"] == voc.encoding.encode_ordinary(after[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"]) for r in stages[5])


def test_a_secret_leaves_the_text(spark, stages):
    docs = spark.createDataFrame(stages[3][:2]).withColumn("text", F.concat("text", F.lit(' token = "0a1b2c3d4e5f60718293a4b5" end')))
    for r in corpus_pipeline.without_secrets(spark, docs, SF).collect():
        assert r["text"].endswith(' [SECRET]" end') and r["n_chars"] == len(r["text"])


def test_stages_take_awkward_documents(spark, docs, empty):
    frame = docs.withColumn("n_chars", docs["at"].cast("long"))
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SF)
        assert 0 < out.count() <= frame.count()
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns, name


def test_stages_take_no_documents(spark, empty):
    rows = empty.withColumn("n_chars", empty["at"].cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        rows = store(stage(spark, rows, SF), "test-empty")
        assert rows.count() == 0, name


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], r["n_tokens"]) for r in stages[5])
