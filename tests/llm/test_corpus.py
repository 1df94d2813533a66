"""Operators over the whole corpus, against brute force, on awkward documents."""

import random

import numpy as np
import pytest

import cases
from cases import docs, empty  # noqa: F401
from respmosaic.llm import bwt, chunks, ngram_join, repeats
from respmosaic.llm.components import components

ROWS = cases.texts()


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (50, 30), (200, 150), (60, 59)):
        pairs = [(i, i + 1) for i in range(m)] if m == 59 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        groups = {}
        for v, r in got.items():
            groups.setdefault(r, set()).add(v)
        want = {}
        for v in {x for p in pairs if p[0] != p[1] for x in p}:
            want.setdefault(root[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_join_on_awkward_documents(docs, empty):
    got = sorted((tuple(r) for r in ngram_join.join(docs)[0].select("id", "n", "component_id").collect()), key=str)
    assert got == sorted(cases.components(ROWS), key=str)
    assert ngram_join.join(empty)[0].count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in cases.components(ROWS) if d is not None and d == c}
    assert {r["doc_id"] for r in kept.collect()} == want | {None}


def test_join_in_large_tiles(spark):
    """Hundreds of texts that share passages: large tiles, several components in them, links that neither leader nor neighbour shows."""
    rng = random.Random(9)
    passages = [cases.prose(rng, 40, 50) for _ in range(3)]
    rows = []
    for i in range(240):
        words = (rng.choice(passages) + " " + " ".join(rng.choices(passages, k=2))).split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words[: rng.randrange(90, 121)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r)[:3] for r in ngram_join.digest(df).collect())
    assert got == sorted(cases.components(rows))


@pytest.mark.parametrize("block", [None, 2_000])
def test_join_lists_every_link(spark, monkeypatch, block):
    """Groups of many near copies, exact copies among them: all links and their number per document, in one block and in several."""
    if block:
        monkeypatch.setattr(ngram_join, "SHINGLES", block)
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = cases.prose(rng, 100, 5000).split()
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(100)] = f"y{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(words[: rng.randrange(94, 101)])))
    rows += [(len(rows) + k, rows[k][1]) for k in range(0, 120, 9)] + [(500, cases.prose(rng, 60)), (501, ""), (502, None)]
    sets = [cases.shingles(t) for _, t in rows]
    pairs = {(x, y) for x in range(len(rows)) for y in range(x) if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert len(pairs) > 1000
    members, links = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = members.collect()
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {r["id"]: r["n_links"] for r in got}
    assert {r["id"]: r["n_links"] for r in got} == {d: sum(i in p for p in pairs) for i, (d, _) in enumerate(rows)}
    node = {r["id"]: r["node"] for r in got}
    want = {tuple(sorted((node[rows[x][0]], node[rows[y][0]]))) for x, y in pairs}
    assert sorted(tuple(r) for r in links.collect()) == sorted(p for p in want if p[0] != p[1])


def test_bitmaps_bound_overlaps_from_above():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (np.frombuffer(ngram_join.signatures(v, np.array([0, len(v)]))[0], np.uint8)[None] for v in (a, b))
        size = min(x.shape[1], y.shape[1])
        assert ngram_join._bound(len(a), len(b), ngram_join.fold(x, size), ngram_join.fold(y, size)) >= len(np.intersect1d(a, b))


def test_merged_transforms_equal_the_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(120):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 130))) for _ in range(rng.randrange(1, 6))]
        base = "".join(rng.choice("abc") for _ in range(300))
        strings += [base[k : k + rng.randrange(0, 150)] for k in (rng.randrange(0, 150) for _ in range(6))] + ["a" * rng.randrange(0, 200)] + strings[:1]
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        total = chunks.prefix_hash(data, chunks.byte_values(False))
        codes = bwt.block_codes(lambda a, b: chunks.span_hash(total, a, b), first)
        cut = sorted({0, len(strings), *rng.sample(range(len(strings)), rng.choice([0, 1, 2, 4]))})
        suffixes, common = bwt.merged(codes, first, list(zip(cut, cut[1:])), 5)
        assert sorted(suffixes.tolist()) == list(range(len(data)))
        owner = np.searchsorted(first, np.arange(len(data)), "right") - 1
        text = "".join(strings)
        windows, groups = {}, {}
        for p in range(len(data)):
            if p + 100 <= first[owner[p] + 1]:
                windows.setdefault(text[p : p + 100], set()).add(p)
        for p, g in zip(suffixes.tolist(), np.cumsum(common < 5).tolist()):
            if p + 100 <= first[owner[p] + 1]:
                groups.setdefault(g, set()).add(p)
        assert sorted(map(sorted, windows.values())) == sorted(map(sorted, groups.values()))


def removed(rows):
    """Expected digest columns, for rows in order of id; repeated (id, text) rows count once."""
    seen, unique = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r not in seen:
            seen.add(r)
            unique.append(r)
    out = {}
    for r, gone in zip(unique, cases.repeats(unique)):
        raw = (r[1] or "").encode()
        runs = sum(1 for i in gone if i - 1 not in gone)
        out[r] = (len(raw), len(gone), runs, cases.sha(bytes(b for i, b in enumerate(raw) if i not in gone)))
    return out


def test_repeats_on_awkward_documents(docs, empty):
    """Repeated ids with different texts have no fixed order, so the one such pair of the fixture shares nothing."""
    rows = [r for r in ROWS if len(r[1] or "") < 50_000 and r[0] is not None]
    df = docs.where("doc_id is not null and coalesce(length(text), 0) < 50000")
    want = removed(rows)
    got = sorted(tuple(r) for r in repeats.digest(df).collect())
    assert got == sorted((r[0], *want[r]) for r in rows)
    assert repeats.digest(empty).count() == 0
    assert repeats.remove_repeats(docs).count() == len(ROWS)


@pytest.mark.parametrize("hot", [2, 4096])
def test_repeats_in_shared_passages(spark, monkeypatch, hot):
    """Passages of different lengths in many texts, with names of few (and, with a low bound, many) different segments."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(11)
    passages = [cases.prose(rng, 40) for _ in range(4)] + ["é漢 " * 60, "ha" * 120]
    rows = []
    for i in range(80):
        parts = [cases.prose(rng, rng.randrange(1, 40)) for _ in range(3)]
        for k in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts.insert(k, p[a : a + rng.randrange(60, len(p))])
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = removed(rows)
    assert sorted(tuple(r) for r in repeats.digest(df).collect()) == sorted((r[0], *want[r]) for r in rows)
