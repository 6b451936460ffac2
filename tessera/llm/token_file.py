"""Token ids in a binary file format with random access: directly addressable codes.

An id is split into chunks, low bits first. Level 0 holds the first chunk of every id, level k+1 the next chunk of those
ids that have bits left after level k; a bitmap per level marks them, and a rank directory (set bits before each block of
512) leads from a position to its place on the next level. Any id, or any document's ids, is read without decoding others.

A segment is one byte string with a header, a document directory and the levels. Segments are stored uncompressed, as
rows of a Parquet table in ascending order of (part, segment), because a cluster's shared store is written through Spark
only; each row says which positions and doc_ids it holds, so that one id is read from one segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, map_arrow, texts
from tessera.llm.tokens import encoder
from tessera.storage import Workspace

MAGIC = b"TDAC2\0\0\0"
#: Bits of each level, whole bytes, so that a chunk is read where it lies; together 32.
WIDTHS = (8, 8, 16)
#: Bits that one entry of a rank directory stands for.
RANK_BLOCK = 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18


def pack_bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of values as planes of bytes, low ones first."""
    return b"".join((values >> np.uint32(at)).astype(np.uint8).tobytes() for at in range(0, width, 8))


def unpack_bytes(raw: np.ndarray, width: int, total: int, first: int, n: int) -> np.ndarray:
    """The values first .. first + n of a packed level of ``total`` values."""
    out = raw[first : first + n].astype(np.uint32)
    for k in range(1, width // 8):
        out |= raw[k * total + first : k * total + first + n].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_segment(doc_ids: list[int | None], ids: list[np.ndarray], widths: tuple[int, ...] = WIDTHS) -> bytes:
    """One segment for documents and their ids, in the order given."""
    values = np.concatenate(ids).astype(np.uint32, copy=False) if ids else np.zeros(0, np.uint32)
    lengths = np.array([len(x) for x in ids], "<u4")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, struct.pack("<IQB", len(doc_ids), len(values), len(widths)), bytes(widths), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), lengths.tobytes()]
    for level, width in enumerate(widths):
        chunk, bitmap, ranks = pack_bytes(values, width), b"", b""
        total = len(values)
        if level + 1 < len(widths):
            values = values >> np.uint32(width)
            goes_on = values > 0
            marks = np.packbits(goes_on)
            blocks = np.zeros(-(-total // RANK_BLOCK) * RANK_BLOCK // 8, np.uint8)
            blocks[: len(marks)] = np.bitwise_count(marks)
            counts = blocks.reshape(-1, RANK_BLOCK // 8).sum(axis=1, dtype=np.int64)
            bitmap, ranks = marks.tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()
            values = values[goes_on]
        parts += [struct.pack("<QIII", total, len(chunk), len(bitmap), len(ranks)), chunk, bitmap, ranks]
    return b"".join(parts)


class Segment:
    """Reads a segment. ``self[i]`` is its i-th id, ``document(k)`` the ids of its k-th document."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token segment")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<IQB", raw, 8)
        at = 8 + struct.calcsize("<IQB")
        widths, at = raw[at : at + n_levels], at + n_levels
        ids, at = np.frombuffer(raw, "<i8", n_docs, at), at + 8 * n_docs
        known, at = np.frombuffer(raw, np.uint8, n_docs, at), at + n_docs
        lengths, at = np.frombuffer(raw, "<u4", n_docs, at), at + 4 * n_docs
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.levels = []
        for width in widths:
            n, *sizes = struct.unpack_from("<QIII", raw, at)
            at += struct.calcsize("<QIII")
            pieces = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
                pieces.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append((width, n, *pieces))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, n, _, bitmap, ranks = self.levels[level]
        if i >= n:
            return self.levels[level + 1][1]
        block = i // RANK_BLOCK
        first = block * RANK_BLOCK // 8
        return int(ranks[block]) + int(np.bitwise_count(bitmap[first : i // 8]).sum()) + (int(bitmap[i // 8]) >> (8 - i % 8)).bit_count()

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for level, (width, total, chunk, bitmap, _) in enumerate(self.levels):
            value |= int(unpack_bytes(chunk, width, total, i, 1)[0]) << shift
            shift += width
            if level + 1 == len(self.levels) or not bitmap[i // 8] >> (7 - i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def ids(self, first: int, n: int) -> np.ndarray:
        """The ids first .. first + n."""
        return self._range(0, first, n)

    def _range(self, level: int, first: int, n: int) -> np.ndarray:
        width, total, chunk, bitmap, _ = self.levels[level]
        values = unpack_bytes(chunk, width, total, first, n)
        if n and level + 1 < len(self.levels):
            goes_on = np.unpackbits(bitmap[first // 8 : -(-(first + n) // 8)])[first % 8 : first % 8 + n].astype(bool)
            if m := int(goes_on.sum()):
                values[goes_on] |= self._range(level + 1, self._rank(level, first), m) << np.uint32(width)
        return values

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


SEGMENTS = "part int, segment int, first_in_part long, n_ids long, first_doc long, last_doc long, payload binary"


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text whole, append ``end_id``, and write segments in ascending doc_id order (null ids first).

    Payloads are stored as they are, without compression, in pages of about one segment, so that a reader that asks for a
    part and a place in it fetches those pages only. A null or empty text has the end id only. Repeated rows are written
    as often as they come; rows with one id lie next to each other. An empty table gives a table without segments. Other
    columns of docs are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
    names = ["part", "segment", "first_in_part", "n_ids", "first_doc", "last_doc", "payload"]

    def segments(batches):
        part, n, first = TaskContext.get().partitionId(), 0, 0
        held, ids, size = [], [], 0

        def segment():
            known = [d for d in held if d is not None] or [None]
            row = (part, n, first, size, known[0], known[-1], encode_segment(held, ids))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(batch.column("text")), strict=True):
                held.append(doc)
                ids.append(np.frombuffer(raw + end, "<u4"))
                size += len(ids[-1])
                if size >= SEGMENT_IDS:
                    yield segment()
                    n, first, held, ids, size = n + 1, first + size, [], [], 0
        if held:
            yield segment()

    ordered = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    bound_batches(ordered.sparkSession)
    writer = ordered.mapInArrow(segments, SEGMENTS).write.mode("overwrite").option("compression", "uncompressed")
    writer.option("parquet.enable.dictionary", "false").option("parquet.page.size.row.check.min", "1").parquet(path)


def _starts(segments: DataFrame) -> DataFrame:
    """(part, base): the ids of all parts before each; one row for each task of the write."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_token_file(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the segments.

    start counts the ids of all documents before it; each part's first id is added up over the parts, of which there are
    as many as the write had tasks.
    """

    def decode(batch: pa.RecordBatch):
        for base, first, raw in zip(*(batch.column(c).to_pylist() for c in ("base", "first_in_part", "payload")), strict=True):
            segment = Segment(raw)
            everything = segment.ids(0, len(segment)).astype("<u4", copy=False)
            cuts = segment.starts.tolist()
            pieces = [everything[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = [pa.array(segment.doc_ids, pa.int64()), pa.array(base + first + segment.starts[:-1]), pa.array(np.diff(segment.starts)), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(pieces, pa.list_(pa.int64()))] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    segments = spark.read.schema(SEGMENTS).parquet(path)
    placed = segments.join(F.broadcast(_starts(segments)), "part").select("base", "first_in_part", "payload")
    return map_arrow(placed, decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def read_ids(spark, path: str, position: int, n: int = 1) -> list[int]:
    """The ids position .. position + n of the whole file, for small n; positions outside of it are an IndexError.

    The starts of the parts say which parts hold them; of those only the segments that the range touches are read, and of
    their levels only the chunks asked for.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    found: list[int] = []
    for row in _starts(segments).where(F.col("base") < position + n).orderBy("base").collect():
        low, high = max(0, position - row["base"]), position + n - row["base"]
        of = segments.where((F.col("part") == row["part"]) & (F.col("first_in_part") < high) & (F.col("first_in_part") + F.col("n_ids") > low))
        for s in of.orderBy("segment").select("first_in_part", "n_ids", "payload").toLocalIterator():
            a, b = max(0, low - s["first_in_part"]), min(s["n_ids"], high - s["first_in_part"])
            found += Segment(bytes(s["payload"])).ids(a, b - a).tolist()
    if position < 0 or len(found) < n:
        raise IndexError(position)
    return found


def read_document(spark, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each row with this doc_id (end id included), from the segments whose range of ids holds it."""
    segments = spark.read.schema(SEGMENTS).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    found = []
    for row in segments.orderBy("part", "segment").select("payload").toLocalIterator():
        segment = Segment(bytes(row["payload"]))
        found += [segment.document(k).tolist() for k, d in enumerate(segment.doc_ids) if d == doc_id]
    return found


def token_file(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token file of docs (to ``path``, or to the shared folder) and return what reading it back gives."""
    spark = docs.sparkSession
    path = path or Workspace(spark, "token-file").new_path("segments")
    write_token_file(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_token_file(spark, path)
