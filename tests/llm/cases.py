"""Shared fixtures: documents with every awkward case, and plain-Python counterparts of the operators."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=5):
    """``(id, text)``: nulls, empty and tiny texts, non-ASCII, ties, repeats, a very long text, near copies and periodic text."""
    rng = random.Random(seed)
    base = prose(rng, 120).split()
    near = []
    for k in range(30):  # a chain of edits: neighbours are alike, the ends are not
        base = list(base)
        base[(7 * k) % 120] = f"edit{k}"
        near.append(" ".join(base))
    long = prose(rng, 30_000, 5000)
    rows = [
        None, "", " ", "\n\t", "word", "two words", "Five WORDS in a row", "five words in a ROW", "é ü ß 漢字 🙂", "a" * 150, "ab" * 400, "x\x0by\x0cz", "!!! ###",
        *near, near[3], near[3].upper(), long, long + " tail", prose(rng, 300), prose(rng, 300), "same line\nother\nsame line\n\nsame line", "The of and " * 40,
    ]
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [(3, "a repeated id with words of its own here"), out[20], out[20], (None, near[5]), (None, None), (None, "no id and few words")]


def shingles(text, width=5):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows):
    """Set size and smallest reachable id per row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(sets[i]), (min(ids[find(i)]) if ids[find(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeats(rows):
    """``{text index: set of removed bytes}`` for rows sorted by id, each (id, text) once."""
    first, gone = {}, []
    for d, (_, text) in enumerate(rows):
        raw, out = (text or "").encode(), set()
        for i in range(len(raw) - 99):
            g = raw[i : i + 100]
            if first.setdefault(g, (d, i)) != (d, i):
                out.update(range(i, i + 100))
        gone.append(out)
    return gone


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The awkward documents with extra columns whose names the operators use themselves."""
    extra = "row string, body string, key string, node string, score string, ids string, n_words string, items string, secrets string, n string"
    rows = [(d, t, ("en", "de", None)[i % 3], ("s1", None)[i % 2], i, *["clash"] * 10) for i, (d, t) in enumerate(texts())]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, at int, {extra}").repartition(3, "at").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
