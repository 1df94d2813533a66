"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy per character class.

Positions come from splitting a text by a pattern: the lengths of the pieces and of the matches between them, summed up, are
the spans. Candidate strings (long runs of token characters) take the narrowest character class that holds them; a window slides over
a candidate with counts kept incrementally (one character leaves, one enters), and the highest window entropy must reach the
class's threshold. Candidates that match an allow-list pattern are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What a text must contain to have a span of the kind at all (a quick test before the spans are taken).
_QUICK = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Candidate strings and the window that slides over them.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes from narrow to wide, each with the window entropy (bits a character) that makes a secret.
CLASSES = (("hex", r"[0-9a-fA-F]+", 3.1), ("capital", r"[A-Z0-9]+", 3.7), ("token", r"[A-Za-z0-9+/_=-]+", 3.9))
#: Candidates that are no secrets: without a digit; words and numbers joined by signs (no letter beside a digit, none of the signs at an end), so
#: all plain numbers; UUIDs, dates and times. No pattern repeats a group: Java's regular expressions would nest one call per repeat.
ALLOW = (r"[^0-9]+", r"(?!.*([A-Za-z][0-9]|[0-9][A-Za-z]))[A-Za-z0-9].*[A-Za-z0-9]", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*")
#: Matches that one fold goes through; longer lists are folded in parts, as a fold copies what it has gathered.
FOLD = 256

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _spans(text: str, kind: str, rank: int, pattern: str, group: int, least: int, quick: str, extra: str = "true") -> Column:
    """Spans of all leftmost non-overlapping matches that pass; ``extra`` is a condition on the match ``x.m``."""
    p = _quoted(pattern)
    return F.expr(
        f"""CASE WHEN {text} RLIKE {_quoted(quick)} THEN transform(array(transform(
            array(named_struct('p', split({text}, {p}, -1), 'm', regexp_extract_all({text}, {p}, 0), 'g', regexp_extract_all({text}, {p}, {group}))),
            v -> zip_with(zip_with(slice(v.p, 1, size(v.m)), v.m, (p, m) -> named_struct('p', p, 'm', m)), v.g, (y, g) -> named_struct('p', y.p, 'm', y.m, 'g', g)))[0]),
          q -> transform(array(transform(sequence(0, greatest(size(q) - 1, 0) div {FOLD}), i -> aggregate(slice(q, i * {FOLD} + 1, {FOLD}),
              named_struct('at', 0, 'out', cast(array() AS {_SPAN})),
              (a, x) -> named_struct('at', a.at + length(x.p) + length(x.m), 'out',
                CASE WHEN length(x.g) >= {least} AND ({extra}) THEN concat(a.out, array(named_struct('start', a.at + length(x.p), 'rank', {rank}, 'end', a.at + length(x.p) + length(x.m), 'kind', '{kind}'))) ELSE a.out END)))),
            parts -> flatten(zip_with(parts, aggregate(parts, named_struct('at', 0, 'all', cast(array() AS array<int>)), (a, c) -> named_struct('at', a.at + c.at, 'all', concat(a.all, array(a.at))), a -> a.all),
              (c, o) -> transform(c.out, y -> named_struct('start', y.start + o, 'rank', y.rank, 'end', y.end + o, 'kind', y.kind)))))[0])[0]
        ELSE cast(array() AS {_SPAN}) END"""
    )


def window_entropy(text: str, window: int = WINDOW) -> str:
    """SQL for the highest Shannon entropy (bits) of any ``window`` consecutive characters of ``text``.

    ``s`` is the sum of c * log2(c) over the window's character counts c. When a character enters or leaves, only its own count changes.
    """
    table = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 2)) + ")"
    count = lambda w, c: f"(length({w}) - length(replace({w}, {c}, '')))"
    f = lambda n: f"element_at({table}, {n} + 1)"
    return f"""aggregate(split({text}, ''), named_struct('w', '', 's', 0D, 'best', 0D),
      (a, c) -> transform(array(CASE WHEN length(a.w) < {window} THEN named_struct('w', a.w, 's', a.s, 'best', a.best)
          ELSE transform(array({count('a.w', 'left(a.w, 1)')}), n -> named_struct('w', substring(a.w, 2), 's', a.s - {f('n')} + {f('n - 1')}, 'best', a.best))[0] END),
        b -> transform(array({count('b.w', 'c')}), n -> transform(array(b.s - {f('n')} + {f('n + 1')}),
          s -> named_struct('w', concat(b.w, c), 's', s, 'best', CASE WHEN length(b.w) = {window - 1} THEN greatest(b.best, {math.log2(window)!r}D - s / {window}) ELSE b.best END))[0])[0])[0],
      a -> a.best)"""


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> DataFrame:
    """``docs`` with an array of ``(start, rank, end, kind)`` appended, by start and then kind, one row per input row.

    Kinds are those of ``BASE`` and ``entropy``. Positions are characters (code points), the end exclusive. Entropy spans that overlap
    a span of a fixed pattern are left out. A null or empty text has none; repeated rows are judged alike; an existing ``out_col`` is
    replaced. Long texts are scanned whole.
    """
    t = f"`{text_col}`"
    fixed = [_spans(t, kind, rank, pattern, group, least, _QUICK[kind]) for rank, (kind, pattern, group, least) in enumerate(BASE)]
    base = docs.withColumn("__base", F.array_sort(F.concat(*fixed)))
    allowed = " OR ".join(f"x.m RLIKE {_quoted(f'^({a})$')}" for a in allow) or "false"
    limit = "CASE " + " ".join(f"WHEN x.m RLIKE {_quoted(f'^{p}$')} THEN {bits!r}D" for _, p, bits in CLASSES) + " END"
    added = _spans(t, "entropy", len(BASE), CANDIDATE, 0, window, CANDIDATE.replace(",}", "}"), f"NOT ({allowed}) AND {window_entropy('x.m', window)} >= {limit}")
    with_added = base.withColumn("__added", added)
    free = F.filter("__added", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    none = F.array().cast(_SPAN)
    found = F.coalesce(F.when(F.size("__added") > 0, F.array_sort(F.concat("__base", free))).otherwise(F.col("__base")), none)
    return with_added.withColumn(out_col, found).drop("__base", "__added")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` (touching and overlapping spans by one); other columns and rows stay."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), docs[text_col].alias("body"))
    found = find_secrets(packed, "body", "spans")
    pieces = F.expr(
        f"""aggregate(spans, named_struct('at', 0, 'out', ''),
          (a, x) -> named_struct('at', greatest(a.at, x.end), 'out',
            CASE WHEN x.start < a.at OR (a.at > 0 AND x.start = a.at) THEN a.out ELSE concat(a.out, substring(body, a.at + 1, x.start - a.at), '{mark}') END),
          a -> concat(a.out, substring(body, a.at + 1)))"""
    )
    body = F.when(F.size("spans") > 0, pieces).otherwise(F.col("body"))
    return found.select("row", body.alias("body")).select(*[F.col("body").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns: counts and digest of the fixed patterns' spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    fixed = F.filter("secrets", lambda x: x["rank"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(secrets, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(fixed), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
