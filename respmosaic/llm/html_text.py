"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks. Each block is a vector: the mean of learned vectors of its hashed tag-path tokens, the mean
of learned vectors of its hashed words, and a few plain numbers. A bidirectional LSTM in numpy reads the sequence in both directions, so that
the whole page speaks for every block, and labels each block as main text or not.

No page carries labels, so a bounded sample of pages teaches by its own markup: blocks inside ``article`` or ``main``, but not inside an
element named as something else, are main text. These texts are also set into invented layouts (other elements and names, without names,
with side bars, notices, adverts, forms and comments around and inside), so that no single tag decides.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks
from respmosaic.llm.html_blocks import Block, blocks

#: Pages that teach, the longest html among them, blocks of a lesson, and invented layouts of a page.
SAMPLE, LONGEST, LESSON, LAYOUTS = 300, 1 << 17, 120, 6
#: Hash buckets and sizes of the learned vectors, plain numbers of a block, and size of each direction's state.
PATHS, WORDS, PATH_SIZE, WORD_SIZE, PLAIN, STATE = 1 << 12, 1 << 13, 16, 8, 8, 16
#: Words of a block read in a lesson; passes, pages and rate of a step of the fit.
SAID, EPOCHS, BATCH, RATE = 30, 5, 48, 0.01
#: Block vectors held at once by a direction.
HELD = 1 << 14

#: Fixed: elements that say nothing about a block's role.
_PLAIN_TAGS = frozenset("html body div section p ul ol li dl dt dd table tbody tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption center".split())
#: Fixed: elements and names by which layouts mark what is not main text.
ROLES = {
    "menu": ("nav div ul menu section", "nav menu navbar navigation breadcrumb breadcrumbs toolbar tabs pagination pager links share social skip"),
    "header": ("header div", "header masthead banner branding logo top head"),
    "footer": ("footer div section", "footer foot bottom copyright legal colophon"),
    "side": ("aside div section", "sidebar side aside rail widget related recommended popular trending toc archive tags"),
    "notice": ("div section p dialog", "notice cookie cookies consent gdpr privacy alert message popup modal overlay newsletter paywall disclaimer"),
    "advert": ("div section aside p", "ad ads advert advertisement advertising sponsor sponsored promo promotion affiliate"),
    "form": ("form fieldset div", "form search login signup contact subscribe"),
    "remarks": ("section div ol ul", "comments comment replies reply respond discussion disqus responses thread"),
}
_MAIN = ("article main div section td", "article post entry content story main body text single")
_NEUTRAL = "wrapper container page layout row col inner outer site wrap grid box block group left right center full sidebar".split()
_OTHER = frozenset(w for tags, words in ROLES.values() for w in words.split()) | {"nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog"}
_LINKS = "Home|About|Contact|News|Login|Search|Next|Previous|More|Share|Print|Top|Archive|Subscribe|Read more".split("|")
_SAYS = {
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "Subscribe to our newsletter", "Please enable JavaScript."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 50%!"],
    "form": ["Search", "E-mail", "Submit", "Your name", "Leave a comment", "Sign up"],
    "remarks": ["Comments", "Reply", "3 comments", "Leave a reply"],
    "footer": ["© All rights reserved.", "Privacy policy", "Terms of use"],
    "side": ["Related", "Most read", "Categories"],
    "header": ["Menu"],
}


class Model(NamedTuple):
    """Learned vectors, the two directions' weights (input, state, bias) and the output's weights."""

    path: np.ndarray
    word: np.ndarray
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray


# --- vectors of blocks -------------------------------------------------------------------------------------------------------------


def _path_tokens(path) -> list[str]:
    tokens, nearest = [], None
    for depth, (tag, words) in enumerate(reversed(path)):
        tokens.append(f"{tag}.{min(depth, 2)}")
        said = ([] if tag in _PLAIN_TAGS else [tag]) + list(words)
        tokens += [f"~{w}" for w in said]
        if said and nearest is None:
            nearest = [f"={w}" for w in said]
    return tokens + (nearest or ["=none"])


_VALUES = chunks.byte_values(fold_case=True)
_seen: dict[tuple, np.ndarray] = {}


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many each has."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    starts, ends, first = chunks.words(data, offsets, chunks.SPACED)
    return chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends), np.diff(first)


def _path_ids(path) -> np.ndarray:
    found = _seen.get(path)
    if found is None:
        if len(_seen) > 20_000:
            _seen.clear()
        found = _seen[path] = np.unique((_hashes(_path_tokens(path))[0] % np.uint64(PATHS)).astype(np.int64))
    return found


def _numbers(page: list[Block], first: int, last: int) -> np.ndarray:
    """Plain numbers of the blocks ``first`` to ``last`` of a page, each within about 0 to 2."""
    out = np.zeros((last - first, PLAIN), np.float32)
    for i, b in enumerate(page[first:last]):
        n = len(b.text)
        out[i] = (
            np.log1p(n) / 5, np.log1p(b.text.count(" ")) / 4, min(1.0, b.linked / n), 1.0 if b.text[-1] in ".!?…。" else 0.0, b.text.count(",") * 10 / (n + 10),
            (first + i) / len(page), 1.0 if "©" in b.text or "|" in b.text else 0.0, np.log1p(len(page)) / 5,
        )
    return out


def _mean(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of the vectors of each run of ``sizes`` ids (zeros for none)."""
    out = np.zeros((len(sizes), table.shape[1]), np.float32)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(table[ids], (np.cumsum(sizes) - sizes)[full], axis=0) / sizes[full, None]
    return out


def _vectors(model: Model, page: list[Block], first: int, last: int) -> np.ndarray:
    """Vectors of a run of blocks."""
    part = page[first:last]
    paths = [_path_ids(b.path) for b in part]
    h, n = _hashes([b.text for b in part])
    return np.concatenate(
        [_mean(model.path, np.concatenate(paths), np.array([len(p) for p in paths])), _mean(model.word, (h % np.uint64(WORDS)).astype(np.int64), n), _numbers(page, first, last)], axis=1
    )


# --- network -----------------------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, weights, mask: np.ndarray, state=None, keep: list | None = None):
    """States ``(time, page, STATE)`` over ``x (time, page, size)``; a masked step leaves the state as it is. ``keep`` collects what the gradient needs."""
    w, u, b = weights
    t, n = x.shape[:2]
    size = u.shape[0]
    h, c = state if state is not None else (np.zeros((n, size), np.float32), np.zeros((n, size), np.float32))
    drive = (x.reshape(-1, x.shape[2]) @ w + b).reshape(t, n, -1)
    out = np.zeros((t, n, size), np.float32)
    for i in range(t):
        z = drive[i] + h @ u
        gate = _sigmoid(z[:, : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        new = gate[:, size : 2 * size] * c + gate[:, :size] * g
        live = mask[i, :, None]
        if keep is not None:
            keep.append((h, c, gate, g, np.tanh(new)))
        c = np.where(live, new, c)
        h = np.where(live, gate[:, 2 * size :] * np.tanh(new), h)
        out[i] = h
    return out, (h, c)


def lstm_gradient(x: np.ndarray, weights, mask: np.ndarray, kept: list, d_out: np.ndarray):
    """Gradients of the input and the weights for :func:`lstm` from a zero state."""
    w, u, _ = weights
    t, n = x.shape[:2]
    size = u.shape[0]
    d_h, d_c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    d_z = np.zeros((t, n, 4 * size), np.float32)
    d_u = np.zeros_like(u)
    for i in range(t - 1, -1, -1):
        h, c, gate, g, tanh = kept[i]
        live = mask[i, :, None]
        d_h = d_h + d_out[i]
        d_new = np.where(live, d_c + d_h * gate[:, 2 * size :] * (1 - tanh**2), 0)
        to_gate = np.concatenate([d_new * g, d_new * c, np.where(live, d_h * tanh, 0)], axis=1)
        d_z[i] = np.concatenate([to_gate * gate * (1 - gate), d_new * gate[:, :size] * (1 - g**2)], axis=1)
        d_u += h.T @ d_z[i]
        d_c = np.where(live, d_new * gate[:, size : 2 * size], d_c)
        d_h = np.where(live, 0, d_h) + d_z[i] @ u.T
    flat = d_z.reshape(t * n, -1)
    return (flat @ w.T).reshape(x.shape), (x.reshape(t * n, -1).T @ flat, d_u, flat.sum(0))


def probabilities(model: Model, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of main text for every block of every page; long pages are read in segments that hand on their state."""
    n, longest = len(pages), max((len(p) for p in pages), default=0)
    if not longest:
        return [np.zeros(0) for _ in pages]
    step = max(1, HELD // n)
    cuts = [(a, min(a + step, longest)) for a in range(0, longest, step)]

    def segment(a: int, b: int):
        x, mask = np.zeros((b - a, n, PATH_SIZE + WORD_SIZE + PLAIN), np.float32), np.zeros((b - a, n), bool)
        for i, page in enumerate(pages):
            m = min(len(page), b) - a
            if m > 0:
                x[:m, i], mask[:m, i] = _vectors(model, page, a, a + m), True
        return x, mask

    single = segment(*cuts[0]) if len(cuts) == 1 else None
    logits, state = np.full((longest, n), model.out[-1], np.float32), None
    for a, b in cuts:
        x, mask = single or segment(a, b)
        h, state = lstm(x, model.forward, mask, state)
        logits[a:b] += h @ model.out[:STATE] + x @ model.out[2 * STATE : -1]
    state = None
    for a, b in reversed(cuts):
        x, mask = single or segment(a, b)
        h, state = lstm(x[::-1], model.backward, mask[::-1], state)
        logits[a:b] += h[::-1] @ model.out[STATE : 2 * STATE]
    return [_sigmoid(logits[: len(p), i]) for i, p in enumerate(pages)]


def _batches(pages: list[list[Block]]) -> Iterator[list[int]]:
    """Indexes of pages of like length whose blocks, filled up to the longest, stay within ``HELD`` (a longer page stands alone)."""
    group: list[int] = []
    for i in sorted(range(len(pages)), key=lambda i: len(pages[i])):
        if group and (len(group) + 1) * len(pages[i]) > HELD:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


# --- lessons -----------------------------------------------------------------------------------------------------------------------


def taught(page: list[Block]) -> list[int] | None:
    """Labels by the page's own markup: inside ``article`` or ``main``, and below it inside nothing named otherwise. None without such an element."""
    out = []
    for b in page:
        inside = 0
        for tag, words in b.path:
            if tag in ("article", "main"):
                inside = 1
            if tag in _OTHER or not _OTHER.isdisjoint(words):
                inside = 0
        out.append(inside)
    return out if any(out) else None


def _names(rng: random.Random, words: str) -> tuple[str, ...]:
    found = rng.sample(words.split(), 1 if rng.random() < 0.7 else 2)
    return tuple(dict.fromkeys(found + ([rng.choice(_NEUTRAL)] if rng.random() < 0.3 else [])))


def _other_block(rng: random.Random, role: str, spare: list[str], path: tuple, named: bool, out: list, labels: list) -> None:
    """A section of some role: its blocks, none of them main text."""
    tags, words = ROLES[role]
    tag = rng.choice(tags.split())
    own_name = _names(rng, words) if named and (tag in ("div", "section", "p", "ul", "ol", "dialog") or rng.random() < 0.5) else ()
    at = (*path, (tag, own_name))
    prose = role in ("remarks", "advert", "footer", "notice", "side")
    for _ in range(rng.choice((1, 1, 2, 4, 7)) if role != "advert" else rng.choice((1, 1, 2))):
        linked = role in ("menu", "side") and rng.random() < 0.85 or role in ("footer", "header") and rng.random() < 0.4
        text = rng.choice(_SAYS.get(role, _LINKS)) if rng.random() < 0.35 else rng.choice(spare)
        if linked:
            text = " ".join(text.split()[: rng.choice((1, 1, 2, 5))])
        elif not prose or rng.random() < 0.4:
            text = " ".join(text.split()[: rng.choice((3, 8, 20))])
        inner = rng.choice(((("ul", ()), ("li", ())), (("li", ()),), (("div", ()),), ())) if linked else rng.choice(((("p", ()),), (("div", ()),), (("h3", ()),), (("div", ("item",)), ("p", ())), ()))
        if role == "remarks" and named and rng.random() < 0.5:
            inner = ((rng.choice(("div", "li")), (rng.choice(("comment", "reply")),)), *inner)
        if text:
            out.append(Block(text, at + inner, len(text) if linked else 0))
            labels.append(0)


def layout(rng: random.Random, main: list[str], spare: list[str]) -> tuple[list[Block], list[int]]:
    """An invented page around ``main``; ``spare`` gives the words of everything else."""
    out: list[Block] = []
    labels: list[int] = []
    named = rng.random() < 0.8
    body = (("html", ()), ("body", ()))
    for _ in range(rng.choice((0, 0, 1, 2))):
        body += ((rng.choice(("div", "div", "section", "table")), (rng.choice(_NEUTRAL),) if rng.random() < 0.6 else ()),)
    before = [r for r in ("header", "menu", "notice", "advert", "menu", "form", "side") if rng.random() < 0.45]
    after = [r for r in ("menu", "advert", "side", "remarks", "form", "notice", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    for role in before:
        _other_block(rng, role, spare, body, named or role in ("advert", "notice"), out, labels)
    tags, words = _MAIN
    tag = rng.choice(("article", *tags.split()))
    inside = (*body, (tag, _names(rng, words) if tag in ("div", "section", "td") and rng.random() < 0.8 or rng.random() < 0.2 else ()))
    if rng.random() < 0.3:
        inside += (("div", (rng.choice((*words.split(), *_NEUTRAL)),) if rng.random() < 0.7 else ()),)
    if tag not in ("article", "main") and not inside[-1][1] and not named:
        inside = (*body, ("article", ()))  # something must tell
    kinds = ["p"] * 12 + ["li", "blockquote", "pre", "h2", "h3", "td", "figcaption", "div"]
    for i, text in enumerate(main):
        kind = rng.choice(("h1", "h1", "h2", "p")) if i == 0 else rng.choice(kinds)
        mid = {"li": (("ul", ()),), "td": (("table", ()), ("tr", ())), "figcaption": (("figure", ()),)}.get(kind, ())
        out.append(Block(text, (*inside, *mid, (kind, ())), len(text) // 3 if rng.random() < 0.1 else 0))
        labels.append(1)
        if rng.random() < 0.1:
            _other_block(rng, rng.choice(("advert", "side", "notice", "form", "menu")), spare, inside, True, out, labels)
    if rng.random() < 0.25:
        _other_block(rng, rng.choice(("remarks", "menu", "side")), spare, inside, True, out, labels)
    for role in after:
        _other_block(rng, role, spare, body, named or role in ("remarks", "advert", "notice"), out, labels)
    return out, labels


def lessons(pages: list[str], layouts: int = LAYOUTS, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Labelled block sequences: pages that teach by their markup, and invented layouts of every page's texts."""
    rng = random.Random(seed)
    read = [b for b in map(blocks, pages) if b]
    spare = [b.text for page in read for b in page][:: max(1, sum(map(len, read)) // 5000)]
    out = []
    for page in read:
        labels = taught(page)
        if labels:
            out.append((page[:LESSON], labels[:LESSON]))
        main = [b.text for b, y in zip(page, labels) if y] if labels else [b.text for b in page if b.text.count(" ") >= 8 and 2 * b.linked < len(b.text)]
        for _ in range(layouts):
            first = rng.randrange(max(1, len(main) - 40))
            used = main[first : first + rng.choice((1, 3, 8, 20, 40))] or [rng.choice(spare)]
            found, marks = layout(rng, used, spare)
            out.append((found[:LESSON], marks[:LESSON]))
    return out


def train(examples: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Adam on the mean log loss of blocks, in batches of pages of like length."""
    rng = np.random.default_rng(seed)
    size = PATH_SIZE + WORD_SIZE + PLAIN
    draw = lambda *shape: (rng.normal(size=shape) * 0.2).astype(np.float32)
    bias = np.zeros(4 * STATE, np.float32)
    bias[STATE : 2 * STATE] = 1
    p = [draw(PATHS, PATH_SIZE), draw(WORDS, WORD_SIZE) * 0.2, draw(size, 4 * STATE), draw(STATE, 4 * STATE), bias, draw(size, 4 * STATE), draw(STATE, 4 * STATE), bias.copy(), draw(2 * STATE + size + 1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    ready = []
    for page, labels in examples:
        h, n = _hashes([b.text for b in page])
        words = np.split((h % np.uint64(WORDS)).astype(np.int64), np.cumsum(n)[:-1])
        ready.append(([_path_ids(b.path) for b in page], words, _numbers(page, 0, len(page)), np.array(labels, np.float32)))
    order, turn = np.argsort([len(r[0]) for r in ready], kind="stable"), 0
    groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            picked = [ready[i] for i in groups[g]]
            t, n = max(len(r[0]) for r in picked), len(picked)
            cell = np.concatenate([np.arange(len(r[0])) * n + i for i, r in enumerate(picked)])
            mask, y = np.zeros(t * n, bool), np.zeros(t * n, np.float32)
            mask[cell], y[cell] = True, np.concatenate([r[3] for r in picked])
            mask, y = mask.reshape(t, n), y.reshape(t, n)
            paths = [ids for r in picked for ids in r[0]]
            said = [w if len(w) <= SAID else rng.choice(w, SAID, replace=False) for r in picked for w in r[1]]
            said = [w if rng.random() < 0.6 else w[:0] for w in said]  # words alone shall not decide
            ids, counts = [np.concatenate(paths), np.concatenate(said)], [np.array([len(x) for x in paths]), np.array([len(x) for x in said])]
            x = np.zeros((t * n, size), np.float32)
            x[cell] = np.concatenate([_mean(p[0], ids[0], counts[0]), _mean(p[1], ids[1], counts[1]), np.concatenate([r[2] for r in picked])], axis=1)
            x = x.reshape(t, n, size)
            kept, kept_back = [], []
            ahead, _ = lstm(x, p[2:5], mask, keep=kept)
            back, _ = lstm(x[::-1], p[5:8], mask[::-1], keep=kept_back)
            read = np.concatenate([ahead, back[::-1], x, np.ones((t, n, 1), np.float32)], axis=2)
            d = np.where(mask, _sigmoid(read @ p[8]) - y, 0).astype(np.float32) / mask.sum()
            d_read = d[..., None] * p[8]
            d_x, ahead_grads = lstm_gradient(x, p[2:5], mask, kept, d_read[..., :STATE])
            d_back, back_grads = lstm_gradient(x[::-1], p[5:8], mask[::-1], kept_back, d_read[::-1, :, STATE : 2 * STATE])
            d_x = (d_x + d_back[::-1] + d_read[..., 2 * STATE : -1]).reshape(t * n, size)[cell]
            grads = [np.zeros_like(p[0]), np.zeros_like(p[1]), *ahead_grads, *back_grads, (read * d[..., None]).sum((0, 1))]
            for k, (lo, hi) in enumerate(((0, PATH_SIZE), (PATH_SIZE, PATH_SIZE + WORD_SIZE))):
                share = d_x[:, lo:hi] / np.maximum(counts[k], 1)[:, None]
                np.add.at(grads[k], ids[k], np.repeat(share, counts[k], axis=0))
            turn += 1
            for k, g_ in enumerate(grads):
                m[k] += 0.1 * (g_ - m[k])
                v[k] += 0.001 * (g_ * g_ - v[k])
                p[k] -= RATE * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    return Model(p[0], p[1], tuple(p[2:5]), tuple(p[5:8]), p[8])


# --- tables ------------------------------------------------------------------------------------------------------------------------


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> Model | None:
    """A model from about ``sample`` different pages of at most ``longest`` characters, chosen by a hash of the html; None where no page has text.

    The fit is one task over that bounded sample, and its weights have a fixed size.
    """
    html = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).where(F.length("html").between(1, longest))
    n = html.agg(F.countDistinct(F.xxhash64("html")).alias("n")).first()["n"]  # copies teach once, however many there are
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    picked = html.where(F.pmod(F.xxhash64("html", F.lit("sample")), F.lit(1 << 30)) < share).distinct()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        examples = lessons(sorted(pdf["html"]))
        if not any(y for _, marks in examples for y in marks):
            return pd.DataFrame({"at": [], "weights": []})
        model = train(examples)
        arrays = [model.path, model.word, *model.forward, *model.backward, model.out]
        return pd.DataFrame({"at": range(len(arrays)), "weights": [a.astype(np.float32).tobytes() for a in arrays]})

    rows = sorted(picked.withColumn("fit", F.lit("one")).groupBy("fit").applyInPandas(one, "at int, weights binary").collect())
    if not rows:
        return None
    size = PATH_SIZE + WORD_SIZE + PLAIN
    shapes = [(PATHS, PATH_SIZE), (WORDS, WORD_SIZE), *[(size, 4 * STATE), (STATE, 4 * STATE), (4 * STATE,)] * 2, (2 * STATE + size + 1,)]
    a = [np.frombuffer(bytes(r["weights"]), np.float32).reshape(s) for r, s in zip(rows, shapes)]
    return Model(a[0], a[1], tuple(a[2:5]), tuple(a[5:8]), a[8])


def main_text(model: Model | None, htmls: list[str | None]) -> list[str]:
    """Main text of each page: its blocks of probability 0.5 or more, joined by line feeds."""
    read = [blocks(h) for h in htmls]
    out = [""] * len(htmls)
    if model is not None:
        for group in _batches(read):
            for i, p in zip(group, probabilities(model, [read[i] for i in group])):
                out[i] = "\n".join(b.text for b, good in zip(read[i], p >= 0.5) if good)
    return out


def extract(pages: DataFrame, model: Model | None, html_col: str = "html", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its code points appended, one row per input row, from the whole html.

    A null or empty page, a page without a block of main text, and any page where nothing could be learned have the text ''. Repeated
    rows are read alike; existing columns of the new names are replaced. Broken and unclosed markup is read to its end.
    """
    names = [c for c in pages.columns if c not in (text_col, size_col)]
    packed = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("text", T.StringType()), T.StructField("size", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            for rows, *_ in chunks.slices(batch, f"row.{html_col}"):
                htmls = chunks.text_column(rows, f"row.{html_col}").to_pylist()
                texts = main_text(shared.value, htmls)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "size"])

    found = packed.mapInArrow(scan, schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("text").alias(text_col), F.col("size").alias(size_col))


def digest(pages: DataFrame) -> DataFrame:
    """Contract columns."""
    rows = pages.select("page_id", "url", "html")
    return extract(rows, fit(rows)).select("page_id", "url", "text", "n_chars")
