"""Vector codes and the source divergence audit against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from respmosaic.llm import divergence, vector_codes

import cases


def product_codes(rows, parts, entries, rounds, scale):
    """Full comparison in Python integers: ``{row index: (code, error)}`` and the codebooks."""
    from fractions import Fraction

    width = -(-len(rows[0]) // parts)
    x = [[int(Fraction(v) * scale // 1) for v in r] + [0] * (parts * width - len(r)) for r in rows]
    cut = [[r[p * width : (p + 1) * width] for p in range(parts)] for r in x]
    books = [[r[p] for r in cut[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(r[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for r in cut]
        if turn < rounds:
            for p in range(parts):
                for i in range(len(books[p])):
                    mine = [r[p] for r, n in zip(cut, near) if n[p][1] == i]
                    if mine:
                        books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(bytes(i for _, i in n), sum(d for d, _ in n)) for n in near], books


@pytest.mark.parametrize("size, rows, kind", [(16, 300, "float"), (10, 90, "double"), (3, 5, "float")])
def test_codes_against_full_comparison(spark, size, rows, kind):
    rng = random.Random(size)
    pick = lambda: rng.choice((0.0, 0.25, -0.5, 1.0, rng.uniform(-2, 2)))
    vectors = [[float(np.float32(pick())) for _ in range(size)] for _ in range(rows)]
    vectors += vectors[:9]  # equal rows under other ids
    want, books = product_codes(vectors, 4, 8, 3, 256)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], f"row long, v array<{kind}>").repartition(5)
    got = vector_codes.encode(df, "v", "row", parts=4, entries=8, rounds=3, scale=256)
    assert {r["row"]["row"]: (bytes(r["code"]), r["error"]) for r in got.rows.collect()} == dict(enumerate(want)) and got.codebooks == books
    near = vector_codes.approximate(got, scale=256).select("approximation").first()[0]
    assert len(near) == 4 * -(-size // 4)


def test_moves_agree_with_full_comparison():
    rng = np.random.default_rng(2)
    for _ in range(60):
        x, old = rng.integers(-9, 10, (200, 3)), rng.integers(-9, 10, (8, 3))
        new = old.copy()
        shift = rng.random(8) < 0.5
        new[shift] += rng.integers(-3, 4, (int(shift.sum()), 3))
        code, d = vector_codes.move(x, vector_codes.nearest(x, old)[0], new, (new != old).any(axis=1))
        want = vector_codes.nearest(x, new)
        assert (code == want[0]).all() and (d == want[1]).all()


def test_vectors_without_a_code(spark):
    big = [3e38, -3e38, 1e30, 5.0]
    good = [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], [-1.0, 0.5, 0.0, 9.0], big]
    odd = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0]]
    rows = [(i, v, "a" if i % 2 else None, "clash") for i, v in enumerate(good + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, code string")
    got = vector_codes.encode(df, parts=2, entries=2, rounds=2)
    want, books = product_codes([[float(np.float32(x)) for x in v] for v in good], 2, 2, 2, 4096)
    assert {r["row"]["vec_id"]: (bytes(r["code"]), r["error"]) for r in got.rows.collect()} == {i: (c, min(e, 2**63 - 1)) for i, (c, e) in enumerate(want)} and got.codebooks == books
    final = {r["vec_id"]: r for r in vector_codes.digest(df.where("vec_id < 3")).collect()}
    assert final[0]["label_error"] == final[0]["error"] + final[2]["error"] and final[1]["label_error"] == final[1]["error"]
    flat = ",".join(str(v) for b in vector_codes.encode(df.where("vec_id < 3")).codebooks for e in b for v in e)
    assert final[0]["codebooks_sha256"] == hashlib.sha256(flat.encode()).hexdigest()
    assert vector_codes.digest(df.where("false")).count() == 0 == vector_codes.digest(df.where("vec_id > 3 and vec_id < 9")).count()


def audit(rows, min_docs=3, top=200):
    """The audit by a loop over all terms of all pairs."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall(cases.lower(text))
        docs[lang].update(set(words))
        count[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        size = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        price = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + len(kept))
        gap = lambda p, q: (p - q) ** 2 // q
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        for s in sources:
            p = {t: price(count[lang, s][t], size[s]) for t in kept}
            pairs = [(o, sum(gap(p[t], price(count[lang, o][t], size[o])) for t in kept)) for o in sources if o != s]
            terms = [(t, p[t], price(whole[t], sum(size.values()))) for t in kept if count[lang, s][t]]
            for part, found, most in (("pair", pairs, None), ("term", [(t, gap(a, b)) for t, a, b in terms if a > b], top)):
                for i, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, i + 1))
    return out


def audit_rows():
    rng = random.Random(8)
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(" ".join(rng.choices([f"{'Ab'[k % 2]}{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(300)], weights, k=rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", "v", None, "w"])) for _ in range(200)]
    return rows + [(None, "en", "no words"), ("", "xx", "a"), ("12 !", "xx", "b"), ("only once", "yy", "a"), (None, None, None), ("same same", "zz", "z"), ("same same", "zz", "z"), ("same", "zz", "z")]


def test_audit_against_loops(spark):
    rows = audit_rows()
    df = spark.createDataFrame([(t, l, s, "clash", 1) for t, l, s in rows], "text string, lang string, source string, term string, n int").repartition(4)
    got = [tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == audit(rows)
    few = {tuple(r) for r in divergence.audit(df, min_docs=1, top=3).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert few == audit(rows, 1, 3)
    assert divergence.audit(df.where("false")).count() == 0


def test_joint_tables_in_any_blocks(spark):
    rows = audit_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = divergence.kept_counts(df)
    want = Counter()
    counts = defaultdict(dict)
    for r in kept.collect():
        counts[r["lang"], r["term"]][r["source"]] = r["n"]
    for (lang, _), c in counts.items():
        for s, a in c.items():
            for t, b in c.items():
                want[lang, s, a, t, b] += 1
    for sizes in ({}, {"terms": 64, "sources": 2}):
        seen = Counter()
        for r in divergence.joint_tables(kept, **sizes).collect():
            seen[r["lang"], r["source"], r["level"], r["other"], r["other_level"]] += r["terms"]
            if r["source"] != r["other"]:
                seen[r["lang"], r["other"], r["other_level"], r["source"], r["level"]] += r["terms"]
        assert seen == want
