"""Language identification of code-switched text by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features; learned transitions say how readily the language changes from one
word to the next. Forward-backward gives each word's posterior. A text's language is the one with the largest
posterior mass, and runs of words with one label are its code-switched spans.

The model is fitted on a bounded sample. Words carry their document's language as label, and training chains are spliced from
segments of different documents, so that transitions are learned from switches whose places are known.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks
from respmosaic.llm.sampling import remainder

#: Buckets of features; sampled documents; words fitted of the sample; words of a chain; most frequent words of a language in its lexicon.
BITS, SAMPLE, FIT_WORDS, CHAIN, LEXICON = 15, 3000, 600_000, 128, 3000
#: Passes, step size, words of a spliced segment at least and at most.
EPOCHS, RATE, SEGMENT = 4, 0.3, (4, 24)

_VALUES = chunks.byte_values(fold_case=True)
_LETTERS = chunks.class_table("".join(chr(c) for c in range(128) if not chr(c).isalpha()))
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32


@dataclass
class Model:
    """Languages, weights of hashed features, lexicon (sorted word hashes and a row of language flags each), its weights, transitions."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    flags: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    mixed = (code.astype(np.uint64) + np.uint64(kind << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Words:
    """Words of a slice of texts: spans, index of each text's first word, hashes, affix buckets, and n-gram buckets of their bytes."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    affixes: np.ndarray
    gram_at: np.ndarray
    gram: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, first = chunks.words(data, offsets, _LETTERS)
    h = chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends)
    b = np.concatenate([_FOLD[data], np.zeros(4, np.int64)])
    size = ends - starts
    affixes = np.empty((6, len(starts)), np.int64)
    head, tail = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for k in range(3):
        head = head * 256 + np.where(size > k, b[np.minimum(starts + k, len(b) - 1)], 0)
        tail = tail * 256 + np.where(size > k, b[np.maximum(ends - 1 - k, 0)], 0)
        affixes[k], affixes[3 + k] = _bucket(head, 1 + k), _bucket(tail, 4 + k)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(ends - 2, starts), -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return Words(starts, ends, first, h, affixes, np.searchsorted(starts, at, "right") - 1, _bucket(b[at] * 65536 + b[at + 1] * 256 + b[at + 2], 7))


def emissions(w: Words, m: Model) -> np.ndarray:
    """Score of every label for every word."""
    n, k = len(w.starts), len(m.languages)
    out = np.zeros((n, k), np.float32)
    for row in w.affixes:
        out += m.weights[row]
    if len(w.gram):
        total = np.concatenate([np.zeros((1, k)), np.cumsum(m.weights[w.gram], axis=0, dtype=np.float64)])
        edges = np.searchsorted(w.gram_at, np.arange(n + 1))
        out += (total[edges[1:]] - total[edges[:-1]]).astype(np.float32)
    if len(m.lexicon):
        slot = np.minimum(np.searchsorted(m.lexicon, w.hashes), len(m.lexicon) - 1)
        known = m.lexicon[slot] == w.hashes
        out[known] += m.flags[slot[known]] @ m.lexicon_weights
    return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors ``[chain, place, label]`` and summed pair posteriors, for chains padded to one length."""
    c, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    live = np.arange(n)[None, :] < lengths[:, None]
    a, b = np.empty_like(e), np.ones_like(e)
    a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, n):
        x = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] = x / x.sum(1, keepdims=True)
    for i in range(n - 2, -1, -1):
        x = (b[:, i + 1] * e[:, i + 1]) @ t.T
        x /= x.sum(1, keepdims=True)
        b[:, i] = np.where(live[:, i + 1, None], x, 1.0 / k)
    p = a * b
    p /= p.sum(2, keepdims=True)
    right = e[:, 1:] * b[:, 1:]
    whole = np.maximum(np.einsum("cni,ij,cnj->cn", a[:, :-1], t, right), 1e-300)
    pair = t * np.einsum("cni,cnj->ij", a[:, :-1] * (live[:, 1:] / whole)[..., None], right)
    return p * live[..., None], pair


def _chains(first: np.ndarray, length: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of chains: every text is cut into chains of at most ``length`` words."""
    size = np.diff(first)
    count = -(-size // length)
    starts = np.repeat(first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * length
    ends = np.repeat(first[1:], count)
    return starts, np.minimum(length, ends - starts)


def posteriors(w: Words, m: Model) -> np.ndarray:
    """Posterior of each label for every word."""
    scores = emissions(w, m)
    starts, lengths = _chains(w.first)
    out = np.zeros_like(scores)
    order = np.argsort(-lengths, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 2048)):
        if not len(part):
            continue
        n = int(lengths[part[0]])
        at = np.minimum(starts[part][:, None] + np.arange(n)[None, :], len(scores) - 1)
        e = scores[at]
        e = np.exp(e - e.max(axis=2, keepdims=True)) + np.float32(1e-12)
        t = np.exp(m.transitions - m.transitions.max()).astype(np.float32)
        a = np.empty_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, n):
            x = (a[:, i - 1] @ t) * e[:, i]
            a[:, i] = x / x.sum(1, keepdims=True)
        ends = lengths[part]
        b = np.ones_like(e[:, 0])
        for i in range(n - 1, -1, -1):
            if i < n - 1:
                x = (b * e[:, i + 1]) @ t.T
                x /= x.sum(1, keepdims=True)
                b = np.where((i + 1 < ends)[:, None], x, 1.0)
            p = a[:, i] * b
            a[:, i] = p / p.sum(1, keepdims=True)
        live = np.arange(n)[None, :] < ends[:, None]
        out[at[live]] = a[live]
    return out


def train(texts: list[str], labels: np.ndarray, languages: list[str], seed: int = 7, words: int = FIT_WORDS) -> Model:
    """Fits a model by AdaGrad on the likelihood of spliced chains."""
    k = len(languages)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    w = read_words(data, offsets)
    owner = np.repeat(labels, np.diff(w.first))
    lexicon, inverse = np.unique(w.hashes, return_inverse=True)
    counts = np.zeros((len(lexicon), k), np.int64)
    np.add.at(counts, (inverse, owner), 1)
    flags = np.zeros((len(lexicon), k), np.float32)
    for j in range(k):
        floor = np.sort(counts[:, j])[-LEXICON] if len(lexicon) > LEXICON else 1
        flags[:, j] = counts[:, j] >= max(2, floor)
    used = flags.any(axis=1)
    m = Model(languages, np.zeros((1 << BITS, k), np.float32), lexicon[used], flags[used], np.zeros((k, k), np.float32), np.zeros((k, k), np.float32))
    if k < 2 or not len(owner):
        return m
    rng = np.random.default_rng(seed)
    grams = np.searchsorted(w.gram_at, np.arange(len(owner) + 1))
    slot = np.minimum(np.searchsorted(m.lexicon, w.hashes), max(0, len(m.lexicon) - 1))
    known = (m.lexicon[slot] == w.hashes) if len(m.lexicon) else np.zeros(len(owner), bool)
    # segments of random length, dealt at random: neighbours in a chain come from different documents
    cuts, at = [], 0
    while at < len(owner):
        at += int(rng.integers(*SEGMENT))
        cuts.append(min(at, len(owner)))
    edges = np.unique(np.concatenate([[0], cuts, w.first]))
    segments = list(zip(edges[:-1], edges[1:]))
    squares = [np.full(x.shape, 1e-6) for x in (m.weights, m.lexicon_weights, m.transitions)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(segments))
        # every language weighs alike, however often it occurs
        share = np.bincount(owner, minlength=k)
        keep = rng.random(len(segments)) < np.minimum(1.0, (words / k) / np.maximum(share, 1))[owner[[s for s, _ in segments]]]
        line = np.concatenate([np.arange(*segments[i]) for i in order if keep[i]] or [np.zeros(0, np.int64)])
        line = line[: len(line) // 64 * 64]
        for batch in np.array_split(line.reshape(-1, 64), max(1, len(line) // (64 * 128))):
            if not len(batch):
                continue
            flat = batch.ravel()
            lo, hi = grams[flat], grams[flat + 1]
            size = hi - lo
            g = w.gram[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            gw = np.repeat(np.arange(len(flat)), size)
            scores = m.weights[w.affixes[:, flat]].sum(axis=0, dtype=np.float64)
            for j in range(k):
                scores[:, j] += np.bincount(gw, m.weights[g, j], len(flat))
            hit = known[flat]
            lex = m.flags[slot[flat]] * hit[:, None] if len(m.flags) else np.zeros((len(flat), k))
            scores += lex @ m.lexicon_weights
            p, pair = forward_backward(scores.reshape(*batch.shape, k), m.transitions.astype(np.float64), np.full(len(batch), 64))
            y = np.eye(k)[owner[flat]]
            d = (y - p.reshape(-1, k)) / len(flat)
            grad = np.zeros(m.weights.shape)
            for j in range(k):
                grad[:, j] = np.bincount(g, d[gw, j], 1 << BITS)
                for row in w.affixes:
                    grad[:, j] += np.bincount(row[flat], d[:, j], 1 << BITS)
            seen = np.zeros((k, k))
            np.add.at(seen, (owner[batch[:, :-1]].ravel(), owner[batch[:, 1:]].ravel()), 1)
            for x, s, gr in zip((m.weights, m.lexicon_weights, m.transitions), squares, (grad, lex.T @ d, (seen - pair) / len(flat))):
                gr = gr - 1e-6 * x
                s += gr * gr
                x += (RATE * gr / np.sqrt(s)).astype(np.float32)
    return m


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Model from at most about ``sample`` rows with text and language (chosen by a hash of the key); None without any.

    The fit runs in one task over that bounded sample, whole texts; a word bound of ``FIT_WORDS`` a language group and pass keeps
    frequent languages from outweighing rare ones.
    """
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null and k is not null")
    per = rows.groupBy("l").count().collect()  # languages are few
    if not per:
        return None
    names = sorted(r["l"] for r in per)
    each = max(1, sample // len(names))
    rate = F.element_at(F.create_map(*[F.lit(x) for r in per for x in (r["l"], min(1 << 30, int(each / r["count"] * (1 << 30)) + 1))]), F.col("l"))
    picked = rows.where(F.pmod(F.xxhash64("k", F.lit("language")), F.lit(1 << 30)) < rate)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["t"], pdf["k"].astype(str)))]
        m = train(pdf["t"].tolist(), np.searchsorted(names, pdf["l"].to_numpy(dtype=object)), names)
        blob = [m.weights.tobytes(), m.lexicon.tobytes(), m.flags.tobytes(), m.lexicon_weights.tobytes(), m.transitions.tobytes()]
        return pd.DataFrame({"part": range(5), "body": blob})

    parts = {r["part"]: r["body"] for r in picked.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(one, "part int, body binary").collect()}
    if not parts:
        return None
    k = len(names)
    table = lambda i, *shape: np.frombuffer(parts[i], np.float32).reshape(*shape)
    return Model(names, table(0, -1, k), np.frombuffer(parts[1], np.uint64), table(2, -1, k), table(3, k, k), table(4, k, k))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def label(docs: DataFrame, model: Model | None, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and, if asked for, ``lang_spans`` appended, one row per input row, from the text alone.

    ``score`` is the predicted language's share of all words' posterior mass. Null texts and texts without letters (and every text
    without a model) are ``und`` with score 0 and no spans. ``lang_spans`` are maximal runs of words with one label, as
    character [start, end). Chains restart after ``CHAIN`` words. Existing columns of these names are replaced.
    """
    new = ["lang_pred", "score", "lang_spans"]
    names = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("lang_spans", SPANS)] * spans])

    def scan(batches):
        m = shared.value
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, text_col):
                n = rows.num_rows
                pred, score, runs = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                w = read_words(data, offsets)
                if m is not None and len(w.starts):
                    p = posteriors(w, m)
                    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
                    mass = total[w.first[1:]] - total[w.first[:-1]]
                    size = np.diff(w.first)
                    best = mass.argmax(axis=1)
                    score = np.where(size > 0, np.round(mass[np.arange(n), best] / np.maximum(size, 1), 6), 0.0)
                    pred = [m.languages[b] if c else "und" for b, c in zip(best, size)]
                    if spans:
                        runs = _runs(w, p.argmax(axis=1), data, offsets, m.languages)
                arrays = [*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(pred, pa.string()), pa.array(score)]
                if spans:
                    arrays.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *new[: 2 + spans]])

    out = docs.mapInArrow(scan, schema)
    none = ~F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = out.withColumn("lang_pred", F.when(none, "und").otherwise(F.col("lang_pred"))).withColumn("score", F.when(none, 0.0).otherwise(F.col("score")))
    return out.withColumn("lang_spans", F.when(none, F.array().cast(SPANS)).otherwise(F.col("lang_spans"))) if spans else out


def _runs(w: Words, best: np.ndarray, data: np.ndarray, offsets: np.ndarray, languages: list[str]):
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        edge = a + np.flatnonzero(np.diff(best[a:b])) + 1 if b > a else np.zeros(0, np.int64)
        lo, hi = np.concatenate([[a], edge]), np.concatenate([edge, [b]])
        base = chars[offsets[d]]
        out.append([{"start": int(chars[w.starts[x]] - base), "end": int(chars[w.ends[y - 1]] - base), "lang": languages[best[x]]} for x, y in zip(lo, hi) if y > x])
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns: the third of the ids by crc32 is held out of the fit."""
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))))
    return label(docs.select("doc_id", "text"), model, spans=False).select("doc_id", held.alias("held_out"), "lang_pred", "score")
