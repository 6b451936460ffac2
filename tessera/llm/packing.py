"""Packing of token sequences into windows by best-fit decreasing.

Documents longer than a window are cut into full windows and a rest. Pieces of one length are alike, so the packing is
planned on the histogram of lengths, whose size is bounded by the window and not by the corpus: a segment tree indexed
by remaining capacity finds the tightest open windows for each length, and windows with the same filling are handled as
one group. The plan says for each range of ranks within a length where its pieces go; a distributed rank within each
length then joins every piece to its place.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, texts
from tessera.llm.tokens import encoder
from tessera.storage import Workspace

#: Pieces are ranked within a length by this many slices of their ids and the length, so that no task gets all of one length.
SLICES = 1024


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many windows are open at each, and the tightest that fits."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.open = [0] * (2 * self.n)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.n
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least at which a window is open, or -1."""
        i = least + self.n
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}. Rows (length, first_rank, n_ranks, sequence, per_sequence, offset):
    of the pieces of this length, those ranked first_rank.. (n_ranks of them) go to sequence, sequence + 1, ...,
    per_sequence to each, from offset on. The steps taken depend on the distinct lengths, not on the pieces."""
    tree, groups = CapacityTree(window), defaultdict(list)  # capacity -> [first sequence, sequences]
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = window
                n = -(-left // (window // length))
                first, sequences = sequences, sequences + n
            else:
                first, n = groups[room].pop()
                tree.add(room, -n)
            each = room // length  # a window that took one piece is tighter than before and takes the next, while it fits
            full = min(n, left // each)
            for count, took in ((full, each), (1 if full < n and left - full * each else 0, left - full * each)):
                if count and took:
                    rows.append((length, rank, count * took, first, took, window - room))
                    if rest := room - took * length:
                        groups[rest].append((first, count))
                        tree.add(rest, count)
                    first, n, rank, left = first + count, n - count, rank + count * took, left - count * took
            if n:
                groups[room].append((first, n))
                tree.add(room, n)
    return rows


def cut_lengths(tokens: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest."""
    return [(s, min(window, tokens - s)) for s in range(0, tokens, window)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, window: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch):
        out = [[] for _ in range(5 + with_ids)]
        for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(batch.column("text")), strict=True):
            raw += end
            n = len(raw) // 4
            for s, m in cut_lengths(n, window):
                part = raw[4 * s : 4 * (s + m)]
                for column, v in zip(out, (doc, s, m, zlib.crc32(part), n, np.frombuffer(part, "<u4") if with_ids else None), strict=False):
                    column.append(v)
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return cut


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row for each piece.

    Each document's ids end with ``end_id``, so a null or empty text is one id. Every id lies in exactly one piece;
    pieces of a sequence lie one behind the other from offset 0. Ties (pieces of one length) go in the order of slice,
    doc_id, start. Repeated rows are packed as often as they come; a null doc_id is kept. An empty table gives no piece.
    ``with_ids`` adds the token ids themselves. Lengths, not documents, come to the driver: at most ``window`` rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    schema = PIECES + (", ids array<long>" if with_ids else "")
    cut = work.save(map_arrow(texts(docs, id_col, text_col), _pieces(tokenizer_path, window, end_id, with_ids), schema), "pieces")
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SLICES)).cast("int"))
    counted = work.save(sliced.groupBy("length", "slice").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, window)
    spread = spark.createDataFrame(rows or [(0,) * 6], "length long, first_rank long, n_ranks long, first_sequence long, per_sequence long, at long")
    before = counted.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"), "n")
    # each (length, slice) knows the rows of the plan that its ranks fall into
    places = before.join(F.broadcast(spread), "length").where("first_rank < before + n and before < first_rank + n_ranks")
    places = places.groupBy("length", "slice", "before").agg(F.sort_array(F.collect_list(F.struct("first_rank", "n_ranks", "first_sequence", "per_sequence", "at"))).alias("places"))
    places = work.save(places, "places")
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = sliced.withColumn("nth", F.row_number().over(order) - 1).join(places, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.withColumn("place", F.filter("places", lambda p: (p["first_rank"] <= F.col("rank")) & (F.col("rank") < p["first_rank"] + p["n_ranks"]))[0])
    nth = F.col("rank") - F.col("place.first_rank")
    each = F.col("place.per_sequence")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("place.first_sequence") + F.floor(nth / each)).alias("sequence_id"), (F.col("place.at") + nth % each * F.col("length")).alias("offset")]
    return ranked.select(*columns, *(["ids"] if with_ids else []))


def padded_length(tokens: int, window: int = 4096) -> int:
    """What a sequence is padded to: the window, unless its length is a power of two."""
    return tokens if tokens and not tokens & (tokens - 1) else window
