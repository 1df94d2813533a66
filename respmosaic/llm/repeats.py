"""Repeated substrings across documents, by merging Burrows-Wheeler transforms of shards.

Two equal ``LENGTH``-byte strings have the same smallest ``GRAM``-byte hash. Consecutive strings of a text with one smallest hash
make a segment, named by that hash, so equal strings always meet under one name. Segments whose name occurs once
hold no repeat. Of segments with equal bytes the first stays and the others go. The different segments of one name are dealt
into bounded buckets; a bucket's shards get their transforms, these are merged by interleave refinement, and suffixes that
share ``LENGTH`` bytes with their neighbour form the repeated intervals, of which the first position stays. Names with more than
``HOT`` different segments (the edges of a very common passage) are dealt on by the hash of each string instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import bwt, chunks
from respmosaic.llm.storage import store

#: Bytes of a repeated string and of the grams that name it.
LENGTH, GRAM = 100, 32
#: Different segments of a name that one bucket takes; bytes of a bucket, on average.
HOT, BUCKET = 4096, 1 << 20
#: Rows of the sorted stream handled at once.
ROWS = 200_000

_VALUES = chunks.byte_values(fold_case=False)
_NO_ID = (1 << 63) - 1  # orders null ids last
_LOCATED = "doc long, tail long"  # tail: 31 bits of the text's hash, then 32 bits of the start


def _sliding(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, name, first start, strings)`` of every segment; starts count from the slice's first byte.

    ``strings`` is negative where the gram that names the segment stands in it more than once: only then can the segment repeat itself.
    """
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    total = chunks.prefix_hash(data, _VALUES)
    at = np.arange(len(data) - GRAM + 1)
    gram = chunks.span_hash(total, at, at + GRAM)
    low = _sliding(gram, width)  # of the string that starts there
    last = np.repeat(offsets[1:] - LENGTH, np.diff(offsets))[: len(low)]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    inside = np.arange(len(low)) <= last
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(low)), 0))
    new |= (np.arange(len(low)) - run) % width == 0  # a run of one name, as in periodic text, is cut
    begins = np.flatnonzero(new & inside)
    stops = np.searchsorted(begins, np.arange(len(low)), "right")  # strings of each segment
    count = np.bincount(stops[inside] - 1, minlength=len(begins))
    # places of naming grams: where a gram is the smallest of some string over it
    edge = np.zeros(width - 1, np.uint64)
    named = np.flatnonzero(~_sliding(~np.concatenate([edge, low, edge]), width) == gram)
    values, rank = np.unique(gram[named], return_inverse=True)
    keys = np.sort(rank * len(data) + named)
    own = np.searchsorted(values, low[begins]) * len(data) + begins
    again = np.searchsorted(keys, own + count + width - 1) - np.searchsorted(keys, own) > 1
    return text[begins], low[begins].view(np.int64), begins, np.where(again, -count, count)


def _places(docs: DataFrame) -> DataFrame:
    """A row per segment: name, hash of its bytes, place and strings. Of equal texts in a slice only the smallest id's is read."""

    def scan(batches):
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, "body"):
                doc, same = np.asarray(rows.column(0)), np.asarray(rows.column(1))
                order = np.lexsort((doc, same))
                first = np.ones(len(order), bool)
                first[1:] = same[order][1:] != same[order][:-1]
                chosen = np.zeros(len(order), bool)
                chosen[order[first]] = True
                text, name, begins, count = segments(data, offsets)
                keep = chosen[text]
                text, name, begins, count = text[keep], name[keep], begins[keep], count[keep]
                content = chunks.span_hash(chunks.prefix_hash(data, _VALUES), begins, begins + np.abs(count) + LENGTH - 1).view(np.int64)
                tail = ((same[text] & 0x7FFFFFFF) << 32) | (begins - offsets[text])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name, content, doc[text], tail, count.astype(np.int16))], names=["name", "content", "doc", "tail", "strings"])

    return docs.select("doc", "same", "body").mapInArrow(scan, f"name long, content long, {_LOCATED}, strings short")


def _firsts(batches):
    """Over rows sorted by name, content and place: the first place (``first``) of each content that shares its name or may repeat itself, and all later places.

    Other names that occur at one place give nothing. The open name is carried on; one that outgrows ``ROWS`` is handled in parts, which
    start with the first place of the content that is open.
    """
    held, rows, open_name = [], 0, None

    def work(final: bool):
        nonlocal held, rows, open_name
        name, content, doc, tail, strings = (np.concatenate(x) for x in zip(*held))
        last = len(name) if final else int(np.searchsorted(name, name[-1]))
        part = not last
        last = last or len(name)
        new_name = np.ones(last, bool)
        new_name[1:] = name[1:last] != name[: last - 1]
        new = new_name.copy()
        new[1:] |= content[1:last] != content[: last - 1]
        group = np.cumsum(new_name) - 1
        several = (np.bincount(group, new)[group] > 1) | (strings[:last] < 0)
        if open_name is not None:
            several |= name[:last] == open_name
        later = ~new
        later[1:] &= (doc[1:last] != doc[: last - 1]) | (tail[1:last] != tail[: last - 1])  # a repeated row is the same place
        out = np.flatnonzero(later | (new & several))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(new[out]), *(pa.array(x[out]) for x in (name, doc, tail, np.abs(strings)))], names=["first", "name", "doc", "tail", "strings"])
        if part:
            if new.sum() > 1:
                open_name = name[-1]
            keep = int(np.flatnonzero(new)[-1])
            held = [tuple(x[keep : keep + 1] for x in (name, content, doc, tail, strings))]
        else:
            held = [tuple(x[last:] for x in (name, content, doc, tail, strings))]
        rows = len(held[0][0])

    for batch in batches:
        held.append(tuple(np.asarray(c) for c in batch.columns))
        rows += batch.num_rows
        if rows >= ROWS:
            yield from work(False)
    if rows:
        yield from work(True)


def _cut(batches):
    """Bytes of the wanted segments of each text; for hot names the hash of each of their strings."""
    for batch in batches:
        for row in batch.to_pylist():
            raw = row["body"].encode()
            data = np.frombuffer(raw, np.uint8)
            total = chunks.prefix_hash(data, _VALUES) if any(w["hot"] for w in row["wanted"]) else None
            out = {c: [] for c in ("name", "doc", "tail", "bytes", "string")}
            for w in row["wanted"]:
                at = w["tail"] & 0xFFFFFFFF
                if w["hot"]:
                    starts = np.arange(at, at + w["strings"])
                    for s, h in zip(starts, chunks.span_hash(total, starts, starts + LENGTH).view(np.int64)):
                        for c, v in zip(out, (None, row["doc"], (w["tail"] >> 32 << 32) | int(s), None, int(h))):
                            out[c].append(v)
                else:
                    for c, v in zip(out, (w["name"], row["doc"], w["tail"], raw[at : at + w["strings"] + LENGTH - 1], None)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("tail", pa.int64()), ("bytes", pa.binary()), ("string", pa.int64())]))


_SPANS = pa.schema([("doc", pa.int64()), ("same", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _spans(doc: np.ndarray, tail: np.ndarray, strings) -> pa.RecordBatch:
    """Bytes of runs of strings, merged where they touch."""
    lo = tail & 0xFFFFFFFF
    order = np.lexsort((tail, doc))
    doc, same, lo, hi = doc[order], (tail >> 32)[order], lo[order], (lo + strings + LENGTH - 1)[order]
    text = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (same[1:] != same[:-1])])[: len(doc)])
    reach = np.maximum.accumulate(hi + text * (1 << 33)) - text * (1 << 33) if len(doc) else hi
    new = np.ones(len(doc), bool)
    new[1:] = (text[1:] != text[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(same[at]), pa.array(lo[at].astype(np.int32)), pa.array(reach[ends].astype(np.int32) if len(ends) else np.zeros(0, np.int32))], schema=_SPANS)


def _interval_spans(table: pa.Table) -> pa.Table:
    """Later places of the repeated intervals of a bucket."""
    doc, tail = (np.asarray(table.column(c)) for c in ("doc", "tail"))
    raw = table.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    total = chunks.prefix_hash(data, _VALUES)
    codes = bwt.block_codes(lambda a, b: chunks.span_hash(total, a, b), first)
    bounds = np.unique([0, np.searchsorted(first, first[-1] // 2), len(raw)])  # two shards of about equal bytes
    suffixes, common = bwt.merged(codes, first, list(zip(bounds[:-1], bounds[1:])), LENGTH // bwt.STRIDE)
    new = common < LENGTH // bwt.STRIDE
    group = np.cumsum(new)
    pick = np.bincount(group)[group] > 1
    suffixes, group = suffixes[pick], group[pick]
    owner = np.searchsorted(first, suffixes, "right") - 1
    long = first[owner + 1] - suffixes >= LENGTH  # suffixes whose last block ends with their segment can agree, too
    suffixes, group, owner = suffixes[long], group[long], owner[long]
    d, t = doc[owner], tail[owner] + (suffixes - first[owner])
    order = np.lexsort((t, d, group))
    d, t, group = d[order], t[order], group[order]
    begins = np.ones(len(group), bool)
    begins[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))
    later = (d != d[head]) | (t != t[head])
    return pa.Table.from_batches([_spans(d[later], t[later], 1)], _SPANS)


def _span_rows(batches):
    for batch in batches:
        doc, tail, strings = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("doc", "tail", "strings"))
        yield _spans(doc, tail, strings.astype(np.int64))


_SPAN_TYPE = "doc long, same long, lo int, hi int"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, same, lo, hi)``: bytes to remove from texts, where ``docs(doc, same, body)`` has ids (none null), text hashes and texts."""
    places = _places(docs).repartition("name").sortWithinPartitions("name", "content", "doc", "tail").mapInArrow(_firsts, f"first boolean, name long, {_LOCATED}, strings short")
    places = store(places, "repeats-places")
    whole = places.where("not first").mapInArrow(_span_rows, _SPAN_TYPE)
    firsts = places.where("first")
    hot = store(firsts.groupBy("name").count().where(F.col("count") > HOT).select("name", F.lit(True).alias("hot")), "repeats-hot")
    wanted = firsts.join(hot, "name", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_text = wanted.groupBy("doc", F.shiftright("tail", 32).alias("short")).agg(F.collect_list(F.struct("name", "tail", "strings", "hot")).alias("wanted"))
    texts = docs.withColumn("short", F.col("same").bitwiseAND(0x7FFFFFFF)).join(per_text, ["doc", "short"]).select("doc", "wanted", "body")
    pieces = store(texts.mapInArrow(_cut, f"name long, {_LOCATED}, bytes binary, string long"), "repeats-pieces")
    size = pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    bucketed = pieces.where("bytes is not null").withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
    inner = bucketed.select("bucket", "doc", "tail", "bytes").groupBy("bucket").applyInArrow(_interval_spans, _SPAN_TYPE)
    strings = pieces.where("string is not null").select("string", "doc", "tail")
    head = strings.groupBy("string").agg(F.min(F.struct("doc", "tail")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select("string", "head")
    later = strings.join(head, "string").where((F.col("doc") != F.col("head.doc")) | (F.col("tail") != F.col("head.tail")))
    edges = later.select("doc", "tail", F.lit(1).cast("short").alias("strings")).mapInArrow(_span_rows, _SPAN_TYPE)
    return store(whole.unionAll(inner).unionAll(edges), "repeats-spans")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``struct row`` (the input row), ``spans`` (removed byte runs ``[lo, hi)``, merged, in order) and ``kept`` (the remaining bytes), per input row.

    A byte goes when a ``LENGTH``-byte string over it also starts earlier: in a row with a smaller id (null ids are the largest), or earlier in the
    same text. Rows with one id and different texts are ordered by a hash of the text; rows with one id and one text are the same document.
    A null or empty text has no bytes. Of equal texts only the first is searched; the others go whole if they have ``LENGTH`` bytes. Strings
    never cross texts. Equality of strings is that of 64-bit hashes of their blocks.
    """
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("same"), F.coalesce(docs[text_col], F.lit("")).alias("body")
    )
    spans = repeated_spans(packed.select("doc", "same", "body"))
    per_text = spans.groupBy("doc", F.col("same").alias("short")).agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    keys = packed.select("doc", "same")
    first = keys.groupBy("same").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least").select("same", "least")
    copies = keys.join(first, "same").where("doc > least").select("doc", F.col("same").bitwiseAND(0x7FFFFFFF).alias("short")).distinct()
    copies = copies.select("doc", "short", F.array(F.struct(F.lit(0).alias("lo"), F.lit((1 << 31) - 1).alias("hi"))).alias("found"))
    marks = store(per_text.unionByName(copies).groupBy("doc", "short").agg(F.flatten(F.collect_list("found")).alias("found")), "repeats-marks")
    joined = packed.withColumn("short", F.col("same").bitwiseAND(0x7FFFFFFF)).join(marks, ["doc", "short"], "left").select("row", "body", "found")
    schema = T.StructType([packed.schema["row"], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, "body"):
                spans, kept = [], []
                for d, found in enumerate(rows.column(2).to_pylist()):
                    text = data[offsets[d] : offsets[d + 1]]
                    runs: list[dict] = []
                    for f in sorted(found or [], key=lambda f: f["lo"]) if len(text) >= LENGTH else []:
                        if runs and f["lo"] <= runs[-1]["hi"]:
                            runs[-1]["hi"] = max(runs[-1]["hi"], min(f["hi"], len(text)))
                        else:
                            runs.append({"lo": f["lo"], "hi": min(f["hi"], len(text))})
                    edges = [0, *(e for r in runs for e in (r["lo"], r["hi"])), len(text)]
                    spans.append(runs)
                    kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["row", "spans", "kept"])

    return joined.mapInArrow(cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns: bytes of each text, bytes and runs removed, digest of the rest."""
    out = remove_repeats(docs.select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["hi"] - x["lo"]))
    return out.select("row.doc_id", (F.length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
