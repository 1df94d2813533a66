"""Byte-level BPE by overlapping chunks, with the ranks of a public vocabulary file.

A text is cut into chunks that overlap. Every chunk is pre-tokenised and its pieces are encoded on their own, so the
chunks of one very long text are dealt over tasks. Neighbouring chunks are stitched at the first boundary inside their
overlap that both have: the pattern looks ahead only, so from a shared boundary on both give the same pieces. Where
an overlap holds no shared boundary (one piece spans it), the stitcher pre-tokenises on from the last certain boundary.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks
from respmosaic.llm.storage import store

#: Characters of a chunk and of the part that it shares with the next.
CHUNK, OVERLAP = 32_768, 512
#: Distinct pieces whose ids a task remembers.
CACHE = 100_000


class Vocabulary:
    """Ranks and pattern of a tiktoken file, loaded once per worker."""

    _loaded: dict[tuple[str, bool], "Vocabulary"] = {}

    def __init__(self, path: str, pattern: str, encodes: bool):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if encodes:
            import tiktoken

            self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        by_id = {i: t for t, i in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str, encodes: bool = True) -> "Vocabulary":
        if (path, encodes) not in cls._loaded:
            cls._loaded[path, encodes] = cls(path, pattern, encodes)
        return cls._loaded[path, encodes]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Little-endian int32 ids of every piece, packed."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = [known.get(p) for p in pieces]
        for k, x in enumerate(out):
            if x is None:
                p = pieces[k]
                out[k] = known.get(p)
                if out[k] is None:
                    out[k] = np.array(self.encoding.encode_ordinary(p), np.int32).tobytes()
                    if len(p) <= 64:
                        known[p] = out[k]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Raw bytes of a run of ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def cut(pattern, text: str, last: bool) -> tuple[list[str], list[int]]:
    """Pieces and their ends. Of a chunk that is not the last, pieces that further text could change are left out."""
    pieces = pattern.findall(text)
    ends = list(accumulate(map(len, pieces)))
    if not last:  # a piece looks at most three characters beyond its start or one beyond its end
        keep = bisect_right(ends, len(text) - 4)
        pieces, ends = pieces[:keep], ends[:keep]
    return pieces, ends


@dataclass
class Part:
    """A chunk: its start in the text, its characters, whether it is the last, the ends of its certain pieces and their ids."""

    start: int
    text: str
    last: bool
    ends: list[int]
    ids: list[bytes]


def stitch(parts: list[Part], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of all pieces of a text from those of its chunks.

    ``at`` is a boundary of the whole text throughout: the start of the text, then one that two neighbours share, or one
    from which the neighbour was pre-tokenised anew because the overlap holds no shared boundary.
    """
    out: list[bytes] = []
    at = 0
    for k, part in enumerate(parts):
        first = bisect_right(part.ends, at - part.start)
        if part.last:
            out += part.ids[first:]
            break
        after = parts[k + 1]
        there = {after.start + e for e in after.ends}
        shared = next((j for j in range(first, len(part.ends)) if part.start + part.ends[j] in there), None)
        stop = len(part.ends) if shared is None else shared + 1
        out += part.ids[first:stop]
        if stop > first:
            at = part.start + part.ends[stop - 1]
        if shared is None:
            text = part.text[at - part.start :] + after.text[part.start + len(part.text) - after.start :]
            pieces, ends = cut(vocabulary.pattern, text, after.last)
            parts[k + 1] = Part(at, text, after.last, ends, vocabulary.ids_of(pieces))
    return out


def _lists(values: list[bytes]) -> pa.Array:
    """List array of packed int32 ids."""
    ends = np.concatenate([[0], np.cumsum([len(v) // 4 for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), np.int32)))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: tuple[str, str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with an array of token ids appended, one row per input row.

    Every match of the pattern is encoded by itself, without special tokens. A null or empty text has no ids. Texts of up to
    ``chunk`` characters are one chunk and are not shuffled; only the chunks of longer ones are dealt over tasks. Repeated rows stay;
    a column already named ``ids_col`` is replaced.
    """
    path, pattern = vocabulary or default_vocabulary()
    names = [c for c in docs.columns if c != ids_col]
    row = F.struct(*[docs[f"`{c}`"] for c in names]).alias("row")
    body = F.coalesce(docs[text_col], F.lit(""))

    def whole(batches):
        voc = Vocabulary.load(path, pattern)
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, f"row.{text_col}"):
                texts = (data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:]))
                ids = [b"".join(voc.ids_of(voc.pattern.findall(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column(0), _lists(ids)], ["row", "ids"])

    rows = docs.where(F.length(body) <= chunk).select(row)
    short = rows.mapInArrow(whole, T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))

    long = store(docs.where(F.length(body) > chunk).select(row, F.monotonically_increasing_id().alias("at")), "bpe-long")
    size = F.length("body")
    cuts = long.select("at", F.col("row").getField(text_col).alias("body")).select("at", "body", F.posexplode(F.sequence(F.lit(1), size, F.lit(chunk))).alias("k", "start")).select(
        "at", "k", (F.col("start") - 1).alias("start"), F.col("body").substr(F.col("start"), F.lit(chunk + overlap)).alias("part"), (F.col("start") + chunk + overlap > size).alias("last")
    )

    def pieces(batches):
        voc = Vocabulary.load(path, pattern)
        for batch in batches:
            for row in range(batch.num_rows):
                at, k, start, text, last = (batch.column(c)[row].as_py() for c in range(5))
                found, ends = cut(voc.pattern, text, last)
                ids = voc.ids_of(found)
                sizes = np.array([len(x) // 4 for x in ids], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([k], pa.int32()), pa.array([start], pa.int32()), pa.array([text]), pa.array([last]),
                     pa.array([ends], pa.list_(pa.int32())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([b"".join(ids)], pa.binary())],
                    ["at", "k", "start", "part", "last", "ends", "sizes", "packed"],
                )

    dealt = cuts.repartition("at", "k").mapInArrow(pieces, "at long, k int, start int, part string, last boolean, ends array<int>, sizes array<int>, packed binary")

    def join(batches):
        voc = Vocabulary.load(path, pattern)
        at, parts = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), _lists([b"".join(stitch(parts, voc))])], ["at", "ids"])

        for batch in batches:
            for row in batch.to_pylist():
                if parts and row["at"] != at:
                    yield done()
                    parts = []
                at, cuts_at = row["at"], np.cumsum([0, *row["sizes"]]) * 4
                if parts and parts[-1].last:  # the chunk before reached the end of the text already
                    continue
                parts.append(Part(row["start"], row["part"], row["last"], row["ends"], [row["packed"][a:b] for a, b in zip(cuts_at, cuts_at[1:])]))
        if parts:
            yield done()

    stitched = dealt.repartition("at").sortWithinPartitions("at", "k").mapInArrow(join, "at long, ids array<int>")
    both = short.unionByName(long.select("row", "at").join(stitched, "at").select("row", "ids"))
    return both.select("row.*", F.col("ids").alias(ids_col))


def decode(tokens: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``tokens`` with the raw bytes of its ids appended (null ids: empty). Ids outside the vocabulary raise."""
    path, pattern = vocabulary or default_vocabulary()
    names = [c for c in tokens.columns if c != bytes_col]
    schema = T.StructType([*[tokens.schema[c] for c in names], T.StructField(bytes_col, T.BinaryType())])

    def back(batches):
        voc = Vocabulary.load(path, pattern, encodes=False)
        for batch in batches:
            step = 256
            for first in range(0, batch.num_rows, step):
                rows = batch.slice(first, step)
                lists = rows.column(rows.schema.get_field_index(ids_col))
                values = np.asarray(lists.flatten(), np.int64)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                raw = voc.decode(values)
                tokens_end = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(voc.size[values])])[tokens_end].astype(np.int32)
                column = pa.BinaryArray.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), column], names=[*names, bytes_col])

    return tokens.mapInArrow(back, schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: token count, digest of the ids and of the bytes decoded from them."""
    out = decode(encode(docs.select("doc_id", "text")).drop("text"))
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
