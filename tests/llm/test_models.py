"""Learned operators: held-out accuracy, defined results on awkward documents, and parts against plain Python."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from cases import docs, empty  # noqa: F401
from conftest import SF
from respmosaic.llm import language, quality, toxicity

TEST = SF.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{TEST}/{t}.parquet") for t in ("documents", "labels")}


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1.0
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_language_held_out(tables):
    got = language.digest(tables["documents"]).join(tables["documents"].select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_language_spans_of_switched_text(spark, tables):
    model = language.fit(tables["documents"])
    by = {r["lang"]: r["text"] for r in tables["documents"].where("n_chars between 600 and 900").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    a, b = by["en"][:300], by["es"][:300]
    rows = spark.createDataFrame([(a + " " + b,)], "text string")
    spans = language.label(rows, model).first()["lang_spans"]
    right = sum(s["end"] - s["start"] for s in spans if s["lang"] == ("en" if s["end"] <= 305 else "es"))
    assert right > 0.9 * sum(s["end"] - s["start"] for s in spans)


def test_language_defined_results(spark, docs, empty, tables):
    model = language.fit(tables["documents"])
    got = {r["at"]: r for r in language.label(docs, model).collect()}
    for at, (_, t) in enumerate(cases.texts()):
        letters = any(c.isalpha() for c in t or "")
        assert (got[at]["lang_pred"] != "und") == letters and bool(got[at]["lang_spans"]) == letters and got[at]["row"] == "clash"
        for s in got[at]["lang_spans"]:
            assert t[s["start"] : s["end"]].strip() == t[s["start"] : s["end"]] and s["end"] > s["start"]
    assert language.fit(empty) is None and language.label(empty, None).count() == 0
    assert {r["lang_pred"] for r in language.label(docs, None).collect()} == {"und"}


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    scores, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 3])
    got, pair = language.forward_backward(scores, t, lengths)
    want, pairs = np.zeros((2, 4, 3)), np.zeros((3, 3))
    for c, n in enumerate(lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        w = np.array([np.exp(sum(scores[c, i, p[i]] for i in range(n)) + sum(t[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            for i in range(n):
                want[c, i, p[i]] += x
            for i in range(n - 1):
                pairs[p[i], p[i + 1]] += x
    assert np.allclose(got, want) and np.allclose(pair, pairs)


def test_toxicity_held_out(tables):
    got = toxicity.digest(tables["documents"], tables["labels"]).join(tables["labels"], "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.75 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{rng.integers(0, 800)}" for _ in range(60)) + (" vile fool" if i % 6 == 0 else " nice day"), int(i % 6 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    w = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert 0 < np.count_nonzero(w) < 3000  # sparse out of 2 ** 20
    fresh = spark.createDataFrame([(1, "w1 w2 vile fool w3"), (2, "w1 w2 nice day w3"), (3, None), (4, "")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(fresh, w).collect()}
    assert s[1] > 0.5 > s[2] and s[3] == s[4]


def test_toxicity_against_a_plain_loop(spark):
    """FTRL-proximal one text and one feature at a time, and its scores, in plain Python."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{rng.integers(0, 40)}" for _ in range(12)) + (" vile fool" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    bias = 1 << toxicity.BITS

    def features(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return [*sorted(set(toxicity.buckets(raw, np.array([0, len(raw)]))[1].tolist())), bias]

    z, n = {}, {}

    def weight(i):
        penalty = 0.0 if i == bias else toxicity.L1
        if abs(z.get(i, 0.0)) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = sorted(rows, key=lambda r: (r[0] * 0x9E3779B1 % (1 << 32), r[1]))
    for _ in range(toxicity.EPOCHS):
        for _, text, y in order:
            own = features(text)
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert {int(i) for i in np.flatnonzero(got)} == set(want) and len(want) > 2
    assert all(got[i] == pytest.approx(w, abs=2e-6) for i, w in want.items())
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(df, got).collect()}
    for i, text, _ in rows:
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-sum(want.get(f, 0.0) for f in features(text)))), abs=1e-5)


def test_toxicity_defined_results(docs, empty):
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert toxicity.fit(docs, labels) is None and toxicity.fit(empty, labels.where("false")) is None  # one class, no rows
    out = toxicity.score(docs, None)
    assert out.count() == docs.count() and {r["score"] for r in out.collect()} == {0.0}
    assert toxicity.score(empty, None).count() == 0


def test_quality_separates_labels(tables):
    got = quality.digest(tables["documents"], tables["labels"]).join(tables["labels"].withColumnRenamed("quality", "y"), "doc_id").toPandas()
    assert auc(got["quality"].to_numpy(), got["y"].to_numpy()) > 0.95
    assert got[got["y"] == 1]["kept"].mean() > 0.99 and got[got["y"] == 0]["kept"].mean() < 0.1


def test_quality_sites_shrink_toward_the_global_share(spark):
    """Equal texts, so only the sites differ: a sparse site's prior is nearer to the global share than a large one's."""
    rows = [(i, "one plain text here", "en", "big" if i < 400 else f"small{i}") for i in range(404)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(404)], "doc_id long, quality int")
    out = {r["source"]: (r["site_prior"], r["evidence"]) for r in quality.classify(df, labels).select("row.source", "site_prior", "evidence").collect()}
    share = 304 / 406
    own = 1 / (1 + np.exp(-(out["big"][1] + np.log(share / (1 - share)))))
    assert out["small400"][0] == pytest.approx(share, abs=2e-3) and len({v for k, v in out.items() if k != "big"}) == 1
    assert abs(out["big"][0] - share) >= abs(out["small400"][0] - share) and min(own, share) - 1e-6 <= out["big"][0] <= max(own, share) + 1e-6


def test_quality_against_a_plain_loop(spark):
    """Ratios by counting, site means by adding up, strengths by the method of moments: all in plain Python."""
    rng = np.random.default_rng(9)
    rows = [(i, "spam " * int(rng.integers(30, 60)) if rng.random() < (0.6 if i % 3 == 0 else 0.2) else " ".join(f"Word{rng.integers(0, 500)}." for _ in range(rng.integers(5, 90))), "en" if i % 2 else "de", f"h{i % 3 if i < 110 else i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = {i: int("spam" not in rows[i][1]) for i in range(0, 120, 2)}
    got = {r["doc_id"]: r for r in quality.classify(df, spark.createDataFrame(list(marks.items()), "doc_id long, quality int")).select("row.doc_id", "evidence", "site_prior", "quality").collect()}
    binned = {}
    for i, t, *_ in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        binned[i] = quality.bins(raw, np.array([0, len(raw)]))[:, 0].tolist()
    total = Counter(marks.values())
    counts = Counter((s, b, marks[i]) for i in marks for s, b in enumerate(binned[i]))
    share = (total[1] + 1) / (len(marks) + 2)
    base = math.log(share / (1 - share))

    def ratio(s, b):
        k = len(list(quality.EDGES.values())[s]) + 1
        one, zero = ((counts[s, b, y] + quality.SMOOTH / k) / (total[y] + quality.SMOOTH) for y in (1, 0))
        return quality.WEIGHT * math.log(one / zero)

    evidence = {i: sum(ratio(s, b) for s, b in enumerate(binned[i])) for i in binned}
    own = {i: 1 / (1 + math.exp(-(e + base))) for i, e in evidence.items()}

    def strength(sites):
        many = [v for v in sites.values() if len(v) >= 2]
        n, s, q = sum(map(len, many)), sum(map(sum, many)), sum(x * x for v in many for x in v)
        ss, nn = sum(sum(v) ** 2 / len(v) for v in many), sum(len(v) ** 2 for v in many)
        within = max(q - ss, 0.0) / max(n - len(many), 1.0)
        spread = (ss - s * s / n - (len(many) - 1) * within) / max(n - nn / n, 1e-9)
        return min(max(within / spread if spread > 0 else quality.STRENGTH[1], quality.STRENGTH[0]), quality.STRENGTH[1])

    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, lang, source in rows:
        hosts[source].append(own[i])
        paths[source, lang].append(own[i])
    a, b = strength(hosts), strength(paths)
    for i, _, lang, source in rows:
        h, p = hosts[source], paths[source, lang]
        host = (sum(h) - own[i] + a * share) / (len(h) - 1 + a)
        prior = (sum(p) - own[i] + b * host) / (len(p) - 1 + b)
        posterior = 1 / (1 + math.exp(-(evidence[i] + math.log(prior / (1 - prior)))))
        assert (got[i]["evidence"], got[i]["site_prior"], got[i]["quality"]) == pytest.approx((evidence[i], prior, posterior), abs=2e-5)


def test_quality_defined_results(docs, empty, tables):
    labels = tables["labels"]
    out = quality.classify(docs, labels)
    assert out.count() == docs.count() and out.where("quality is null or site_prior is null").count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs, labels.where("false")).where("quality < 0.5").count() == 0  # nothing learned, nothing rejected
    assert quality.keep_good(empty, labels).count() == 0
