"""Exact ranked lexical search by sparse ball trees.

A document is a sparse vector of whole numbers, the impact of each term, and a query a vector of term weights: the score is
their inner product. Queries are a stated set, taken in blocks whose terms have a bound; documents are reduced to the terms of a
block, whatever their length. Each task builds a ball tree over each stretch of its documents, in the space scaled by the
weights. A node has its centroid and, for each of a few groups of terms, the radius within which its documents lie: no document
below it scores more than the centroid's product and, group by group, the product of the query's norm and the radius. Bounds are
computed in doubles and widened by more than their rounding can be. Subtrees are visited best bound first, for each query with the
k-th score so far as the limit, which goes on from tree to tree; leaves are scored in 64-bit whole numbers. Each task's k best
of each query then meet.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, map_arrow
from tessera.storage import Workspace

#: Terms and queries of one block, documents of one tree, documents of one leaf, groups of terms.
BLOCK_TERMS, BLOCK_QUERIES, TREE_ROWS, LEAF_ROWS, GROUPS = 16_384, 1024, 4096, 32, 256
#: By how much a bound in doubles is widened, relative to its parts; sums of 2**20 products err by less.
SAFE = 1e-9

#: Bytes that end a term become spaces, A-Z become lower case; all bytes above 0x7F belong to terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of letters and digits, and of all characters beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """[(item id, its terms)] of all items, in blocks; an item of more than BLOCK_TERMS terms is a block of its own."""
    block, known = [], set()
    for row in items.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        terms = list(dict.fromkeys(terms_of(row[1].encode())))
        if block and (len(block) == BLOCK_QUERIES or len(known | set(terms)) > BLOCK_TERMS):
            yield block
            block, known = [], set()
        block.append((row[0], terms))
        known |= set(terms)
    if block:
        yield block


class BallTree:
    """A binary tree over the rows of one stretch of documents. Node 0 is the root; a leaf has a range of ``order``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, group: np.ndarray, leaf_rows: int = LEAF_ROWS):
        """Row r has values[starts[r]:starts[r+1]] at columns[...], scaled. group: the group of each column."""
        self.starts, self.columns, self.values, self.group = starts, columns, values, group
        self.groups, self.width = int(group.max(initial=0)) + 1, len(group)
        self.nnz = np.diff(starts)
        self.rows_of = np.repeat(np.arange(len(starts) - 1), self.nnz)
        self.square = np.bincount(self.rows_of, values**2, len(starts) - 1)
        self.order = np.arange(len(starts) - 1)
        self.children: list[tuple[int, int] | None] = []
        self.ranges: list[tuple[int, int]] = []
        self.centroids: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self._grow(0, len(self.order), leaf_rows)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the row in rows, entry) of all entries of rows."""
        n = self.nnz[rows]
        local = np.repeat(np.arange(len(rows)), n)
        return local, np.arange(len(local)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n)

    def _grow(self, low: int, high: int, leaf_rows: int) -> int:
        rows = self.order[low:high]
        local, at = self._entries(rows)
        columns, values = self.columns[at], self.values[at]
        centroid = np.bincount(columns, values, self.width) / len(rows)
        # squared distance by group: of the row's part, less twice its product with the centroid, and the centroid's part
        cell = local * self.groups + self.group[columns]
        parts = np.bincount(cell, values**2, len(rows) * self.groups).reshape(len(rows), -1)
        dots = np.bincount(cell, values * centroid[columns], len(rows) * self.groups).reshape(len(rows), -1)
        middle = np.bincount(self.group, centroid**2, self.groups)
        apart = np.maximum(parts - 2 * dots + middle, 0)
        node = len(self.ranges)
        self.ranges.append((low, high))
        self.children.append(None)
        self.centroids.append(centroid)
        self.radii.append(np.sqrt(apart + SAFE * (parts + middle)).max(axis=0))
        if high - low > leaf_rows:
            # two far rows: the one farthest from the centroid, and the one farthest from that
            first = self._distances(rows, local, columns, values, int(apart.sum(axis=1).argmax()))
            second = self._distances(rows, local, columns, values, int(first.argmax()))
            by = np.argsort(first - second, kind="stable")
            cut = int(np.searchsorted((first - second)[by], 0))
            if not len(rows) // 8 <= cut <= len(rows) - len(rows) // 8:
                cut = len(rows) // 2
            self.order[low:high] = rows[by]
            self.children[node] = (self._grow(low, low + cut, leaf_rows), self._grow(low + cut, high, leaf_rows))
        return node

    def _distances(self, rows, local, columns, values, to: int) -> np.ndarray:
        point = np.zeros(self.width)
        span = slice(self.starts[rows[to]], self.starts[rows[to] + 1])
        point[self.columns[span]] = self.values[span]
        return self.square[rows] - 2 * np.bincount(local, values * point[columns], len(rows)) + self.square[rows[to]]

    def bounds(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(node, query): no row below the node has a greater product with the query. queries: (column, query); norms: the norms
        of each query's groups, (group, query)."""
        middles = np.array(self.centroids)
        return (middles @ queries + np.array(self.radii) @ norms) * (1 + SAFE)


def best_first(tree: BallTree, bounds: np.ndarray, score, held: list, k: int) -> int:
    """Puts the k best (score, key) into the heap ``held``, given one query's bounds; returns the number of leaves visited. Equal
    scores are all looked at."""
    open_, leaves = [(-bounds[0], 0)], 0
    while open_:
        bound, node = heapq.heappop(open_)
        if len(held) == k and -bound < held[0][0]:
            break
        if tree.children[node] is None:
            leaves += 1
            for entry in score(node):
                if len(held) < k:
                    heapq.heappush(held, entry)
                elif entry > held[0]:
                    heapq.heapreplace(held, entry)
        else:
            for child in tree.children[node]:
                if len(held) < k or bounds[child] >= held[0][0]:
                    heapq.heappush(open_, (-bounds[child], child))
    return leaves


class Search:
    """One block of queries over stretches of documents, with the k best of each query so far."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, k: int, n: int, length: int):
        self.k, self.n, self.length = k, n, length
        self.weights = weights
        # the space is scaled by the weights' roots, documents and queries alike
        self.scale = np.sqrt(np.maximum(weights, 1).astype(np.float64))
        self.items = [np.array(t, np.int64) for t in items]
        self.queries = np.zeros((len(weights), len(items)))
        for q, t in enumerate(self.items):
            self.queries[t, q] = weights[t] / self.scale[t]
        self.group = term_groups(items, len(weights))
        groups = int(self.group.max(initial=0)) + 1
        self.norms = np.sqrt(np.array([(self.queries[self.group == g] ** 2).sum(axis=0) for g in range(groups)]).reshape(groups, -1))
        self.held: list[list] = [[] for _ in items]
        self.leaves = self.visited = 0

    def add(self, ids: list, lengths: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """A stretch of documents: ids, their numbers of terms, and (term, tf) by document."""
        m = 10 + (90 * lengths * self.n) // self.length
        tfs = tfs.astype(np.int64)
        impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, np.diff(starts)))
        tree = BallTree(starts, terms, impacts * self.scale[terms], self.group)
        bounds = tree.bounds(self.queries, self.norms)
        # ties go to the smaller doc_id, null ones first: keys by which the greater entry is the better one
        keys = [(1, 0) if d is None else (0, -d) for d in ids]
        tables = {}

        def leaf(node):
            if node not in tables:
                rows = tree.order[slice(*tree.ranges[node])]
                local, at = tree._entries(rows)
                own, place = np.unique(terms[at], return_inverse=True)
                table = np.zeros((len(own), len(rows)), np.int64)
                table[place, local] = impacts[at] * self.weights[terms[at]]
                tables[node] = rows, own, table
            return tables[node]

        for q, t in enumerate(self.items):

            def score(node, t=t):
                rows, own, table = leaf(node)
                at = np.searchsorted(own, t)
                at = at[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == t)] if len(own) else at[:0]
                found = table[at].sum(axis=0)
                return [(int(found[i]), keys[rows[i]]) for i in np.nonzero(found)[0]]

            self.visited += best_first(tree, bounds[:, q], score, self.held[q], self.k)
        self.leaves += sum(c is None for c in tree.children) * len(self.items)


def term_groups(items: list[list[int]], terms: int) -> np.ndarray:
    """A group below GROUPS for each term, terms of like items together: each item joins the group with which it shares
    most terms, or opens one."""
    group, found = np.full(terms, -1, np.int64), 0
    for t in sorted(items, key=len, reverse=True):
        seen = Counter(int(g) for g in group[t] if g >= 0)
        best = max(seen, key=lambda g: (seen[g], -g), default=-1)
        if (best < 0 or 4 * seen[best] < len(t)) and found < GROUPS:
            best, found = found, found + 1
        own = [x for x in t if group[x] < 0]
        group[own] = max(best, 0)
    return np.maximum(group, 0)


VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
HITS = "query int, doc_id long, score long"


def _vectors(known: dict[bytes, int]):
    def run(batch: pa.RecordBatch):
        n, starts, terms, tfs = [], [0], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            every = terms_of(text)
            counted = sorted(Counter(known[t] for t in every if t in known).items())
            n.append(len(every))
            terms += [t for t, _ in counted]
            tfs += [c for _, c in counted]
            starts.append(len(terms))
        offsets = pa.array(starts, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def _searched(make, with_counts: bool):
    def run(batches):
        search, held, rows = make(), [], 0

        def stretch():
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("terms").combine_chunks()
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            search.add(table.column("doc_id").to_pylist(), table.column("n").to_numpy(), starts, lists.flatten().to_numpy().astype(np.int64), table.column("tfs").combine_chunks().flatten().to_numpy())

        for batch in batches:
            for k in range(0, len(batch), TREE_ROWS):
                part = batch.slice(k, TREE_ROWS)
                if rows + len(part) > TREE_ROWS:
                    stretch()
                    held, rows = [], 0
                held.append(part)
                rows += len(part)
        if rows:
            stretch()
        found = [(q, None if null else -negative, score) for q, heap in enumerate(search.held) for score, (null, negative) in heap]
        if with_counts:
            found.append((-1, search.leaves, search.visited))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    return run


def _block_hits(docs: DataFrame, block: list, k: int, work: Workspace, with_counts: bool) -> DataFrame:
    """(query, doc_id, score), at most k rows a task and query."""
    known = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
    vectors = work.save(map_arrow(docs, _vectors(known), VECTORS), "vectors")
    sizes = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator()}  # a row for each of the block's terms
    n, length = sizes[0], max(1, sizes[1])
    weights = np.array([weight(df.get(i, 0), n) for i in range(len(known))], np.int64)
    items = [sorted(known[t] for t in terms) for _, terms in block]
    bound_batches(docs.sparkSession)
    found = vectors.where(F.size("terms") > 0).mapInArrow(_searched(lambda: Search(items, weights, k, n, length), with_counts), HITS)
    return work.save(found, "hits")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each row of items, ties by doc_id.

    All documents are searched, and their statistics are those of the whole table, documents without a term left out. Null texts have no
    terms. Repeated documents are hits of their own, repeated items have their hits as often as they come; a null doc_id
    comes before others of its score. An empty table on either side gives an empty one. Items come to the driver in blocks of
    up to BLOCK_QUERIES items or BLOCK_TERMS terms, and documents are read once for each block.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lexical")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    every = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    for block in query_blocks(items, item_id, item_text):
        hits = _block_hits(rows, block, k, work, False)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query int, item_id {kind}")
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        every = every.unionByName(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return every


def visited_share(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> float:
    """The share of all leaves, over all queries, that a search has to score; the rest lies in subtrees that bounds exclude."""
    work = Workspace(docs.sparkSession, "lexical")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    leaves = visited = 0
    for block in query_blocks(items, item_id, item_text):
        counts = _block_hits(rows, block, k, work, True).where("query = -1").agg(F.sum("doc_id"), F.sum("score")).first()
        leaves, visited = leaves + (counts[0] or 0), visited + (counts[1] or 0)
    return visited / leaves if leaves else 0.0
