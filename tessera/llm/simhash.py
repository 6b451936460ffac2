"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are grouped in tiles by the population counts of their sub-words. Two fingerprints that differ in r bits
have sub-word counts whose differences add up to r at most, so a pair of tiles whose counts differ beyond the radius is
skipped without a look, and no pair within the radius is lost. The other pairs of tiles are compared whole with
exclusive-or and bit counts in numpy. Each comparison returns a spanning forest of its links, not all pairs.

Where links are held against an exact similarity besides (one_of_each), what fingerprints and forests leave out is found by the
prefixes of the documents' sets of shingles, for pairs that aren't connected yet.
"""

from __future__ import annotations


import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_dealt, map_arrow
from tessera.operators.components import connected_components
from tessera.storage import Workspace

SEED = 42
#: Fingerprints of one tile, about; cells with more are split by a hash.
TILE = 1024
#: Up to so many fingerprints four sub-words are compared, beyond them eight: finer cells, fewer comparisons, the same links.
FINER_ABOVE = 3_000_000


def shingle_digests(text: str | None, words: int, seed: int = SEED) -> bytes:
    """XXH64 of every shingle, big-endian, end to end. A text with fewer words is one shingle; one without, none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return b""
    joined = b" ".join(found)
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return digest(joined, seed)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)])


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if set in over half of the shingles' hashes; as a signed number."""
    bits = np.unpackbits(np.frombuffer(shingle_digests(text, words), np.uint8)).reshape(-1, 64)
    set_in = bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_in > len(bits)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; the fingerprint of a null text, or one without a word, is zero. Null ids and repeated rows are
    kept as they come, and an empty table gives an empty result."""

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), mark, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, radius: int, pairs_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) between the ids of rows of a and b (one 64-bit word a column) that differ in radius bits or fewer,
    reduced to ones that connect the same ids; of the links that could connect two parts, the nearest."""
    step = max(1, pairs_at_once // max(1, len(b)))
    a, b = a.view(np.uint64), b.view(np.uint64)  # bit counts of signed numbers are those of their magnitudes
    nodes = np.unique(np.concatenate([a_ids, b_ids]))
    found, held = [np.zeros((3, 0), np.int64)], 0
    for k in range(0, len(a), step):
        differ = sum(np.bitwise_count(a[k : k + step, None, w] ^ b[None, :, w]) for w in range(a.shape[1]))
        i, j = np.nonzero(differ <= radius)
        some = np.stack([a_ids[k + i], b_ids[j], differ[i, j].astype(np.int64)])
        found.append(some[:, some[0] != some[1]])
        held += found[-1].shape[1]
        if held > 4 * len(nodes):
            found = [_reduced(nodes, np.concatenate(found, axis=1))]
            held = found[0].shape[1]
    x, y, _ = _reduced(nodes, np.concatenate(found, axis=1))
    return x, y


def _reduced(nodes: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The minimum spanning forest of links (x, y, bits): in every round each part takes its nearest link to another."""
    links = links[:, np.argsort(links[2], kind="stable")]
    x, y = np.searchsorted(nodes, links[0]), np.searchsorted(nodes, links[1])
    label, taken = np.arange(len(nodes)), np.zeros(links.shape[1], bool)
    while True:
        left = np.flatnonzero(label[x] != label[y])[::-1]
        if not len(left):
            return links[:, taken]
        nearest = np.full(len(nodes), -1)
        nearest[label[x[left]]] = left  # the last one written, which is the nearest, stays
        other = np.full(len(nodes), -1)
        other[label[y[left]]] = left
        both = np.where((nearest < 0) | ((other >= 0) & (other < nearest)), other, nearest)
        picked = np.unique(both[both >= 0])
        taken[picked] = True
        u, v = label[x[picked]], label[y[picked]]
        part = np.arange(len(nodes))
        while (part[u] != part[v]).any():
            low = np.minimum(part[u], part[v])
            for at in (part[u], part[v]):
                np.minimum.at(part, at, low)
            part = part[part]
        while (part != part[part]).any():
            part = part[part]
        label = part[label]


def _compared(pairs: DataFrame, radius: int, words: int) -> DataFrame:
    """(src, dst) from pairs of tiles a and b, arrays of (id, w0, w1, ...)."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sides = []
        for name in ("a", "b"):
            c = batch.column(name)
            fields = [c.values.field(k).to_numpy() for k in range(words + 1)]
            sides.append((c.offsets.to_numpy(), fields[0], np.stack(fields[1:], axis=1)))
        (ao, ai, av), (bo, bi, bv) = sides
        for k in range(batch.num_rows):
            p, q = slice(ao[k], ao[k + 1]), slice(bo[k], bo[k + 1])
            x, y = forest(av[p], bv[q], ai[p], bi[q], radius)
            src.append(x)
            dst.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return map_arrow(pairs, compare, "src long, dst long")


def _tiles(celled: DataFrame, words: int, tile: int, work: Workspace) -> DataFrame:
    """(cell, tile, items): the rows (id, w0, ..., cell) in tiles of about ``tile`` rows of one cell."""
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1")
    split = work.save(celled.join(sizes, "cell", "left").withColumn("tile", F.pmod(F.xxhash64("id"), F.coalesce("tiles", F.lit(1))).cast("int")), "cells")
    return work.save(split.groupBy("cell", "tile").agg(F.collect_list(F.struct("id", *(f"w{k}" for k in range(words)))).alias("items")), "tiles")


def _sub_words(blocks: int) -> list[tuple[int, int]]:
    width = 64 // blocks
    return [(k * width, width) for k in range(blocks)]


def _cell(fp: Column, blocks: int) -> Column:
    """The sub-words' population counts, in one number."""
    cell = F.lit(0).cast("long")
    for at, width in _sub_words(blocks):
        cell = cell * (width + 1) + F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return cell


def _near_cells(blocks: int, radius: int) -> list[list[int]]:
    """Differences of counts that add up to radius at most, half of them: each pair of cells once."""
    steps = [[]]
    for _ in range(blocks):
        steps = [s + [d] for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in steps if s >= [0] * blocks]


def links(distinct: DataFrame, radius: int, work: Workspace, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(src, dst): links between the distinct fingerprints in column fp that connect all within the radius."""
    blocks = blocks or (4 if distinct.count() <= FINER_ABOVE else 8)
    width = 64 // blocks
    tiles = _tiles(distinct.select(F.col("fp").alias("id"), F.col("fp").alias("w0"), _cell(F.col("fp"), blocks).alias("cell")), 1, tile, work)
    counts = [(F.floor(F.col("cell") / F.lit((width + 1) ** (blocks - 1 - k))).cast("long") % (width + 1)) for k in range(blocks)]
    near = F.array(*(F.array(*(F.lit(d) for d in s)) for s in _near_cells(blocks, radius)))
    left = tiles.select(F.array(*counts).alias("counts"), F.col("tile").alias("a_tile"), F.col("items").alias("a"), F.explode(near).alias("step"))
    left = left.withColumn("to", F.zip_with("counts", "step", lambda c, d: c + d)).where(F.forall("to", lambda c: c.between(0, width)))
    pairs = left.select(
        F.aggregate("to", F.lit(0).cast("long"), lambda s, c: s * (width + 1) + c).alias("cell"), "a_tile", "a", F.forall("step", lambda d: d == 0).alias("own")
    ).join(tiles, "cell").where("not own or a_tile <= tile").select("a", F.col("items").alias("b"))
    return work.save(_compared(pairs, radius, 1), "links")


#: Bits in which fingerprints of 128 bits of whole documents may differ, so that they are compared further. Pairs with a similarity
#: of 0.8 differ in 19 bits with a deviation of 4; unrelated ones in 64 with a deviation of 6.
WIDE_RADIUS = 28


#: One document in SAMPLE is asked which shingles are frequent, and at most FREQUENT of these are told to the tasks. Both bear on the order in
#: which shingles are taken, and so on the work, but not on what is found.
SAMPLE, FREQUENT = 16, 1 << 17
#: Pairs of one batch of places that are compared at once.
PAIRS_AT_ONCE = 1 << 18


def _shingle_set(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """The distinct shingles of a text, in order."""
    return np.unique(np.frombuffer(shingle_digests(text, words, seed), ">u8")).astype(np.uint64)


def _wide_fingerprint(halves: list[np.ndarray]) -> list[int]:
    """A fingerprint of each of two sets, in which every shingle counts once as in the similarity."""
    marks = []
    for h in halves:
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
        marks.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.uint32) > len(bits)).view(">i8")[0]))
    return marks


def _content(text: str | None) -> int:
    """A digest of the sequence of words."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(raw), SEED), "big", signed=True)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, given as sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _frequent(source: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, how frequent each is, from 1 to 31) of those that a sample of the documents has more than once."""

    def shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [_shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["h"])

    seen = map_arrow(source.where(F.pmod("row", F.lit(SAMPLE)) == 0).select("text"), shingle, "h long")
    most = seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "h").limit(FREQUENT).toPandas()
    h = most["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.minimum(31, np.log2(most["n"].to_numpy(np.float64))).astype(np.uint64)[order]


def _ordered(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Numbers that stand for shingles and put the rare ones first; one order for all documents."""
    known, level = frequent
    own = np.zeros(len(shingles), np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        own = np.where(known[at] == shingles, level[at], np.uint64(0))
    return np.sort((own << np.uint64(58)) | (shingles >> np.uint64(6)))


def prefix_length(n: int, similarity: float) -> int:
    """So many of its first shingles a set needs to meet all that are so similar to it in one of theirs."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _verified(edges: DataFrame, source: DataFrame, marked: DataFrame, words: int, similarity: float, work: Workspace, repeated: bool) -> DataFrame:
    """Those edges (src, dst) between nodes whose sets of shingles have the similarity. One text of each node with an edge is moved, which takes
    less room than its shingles; nodes with many edges are dealt out in copies. The joins are shuffles at every size (the hints "merge"), so that
    a small corpus is worked on as a large one is."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    one = marked.groupBy("node").agg(F.min("row").alias("row"))
    wanted = work.save(one.join(ends.hint("merge"), "node").select("row", "node"), "wanted")
    held = source.select("row", "text").join(wanted.hint("merge"), "row").select("node", "text")
    held = work.save(held.dropDuplicates(["node"]) if repeated else held, "texts")
    side = lambda end, name: held.select(F.col("node").alias(end), F.col("text").alias(name)).hint("merge")
    both = join_dealt(join_dealt(edges, side("src", "a"), "src", ["dst"], work), side("dst", "b"), "dst", ["src"], work, edges)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, good = {}, []
        columns = (batch.column(c).to_pylist() for c in ("src", "dst", "a", "b"))
        for src, dst, a, b in zip(*columns, strict=True):
            if len(sets) > 2048:
                sets.clear()
            for node, text in ((src, a), (dst, b)):
                if node not in sets:
                    sets[node] = _shingle_set(text, words)
            good.append(jaccard(sets[src], sets[dst]) >= similarity)
        return batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    found = work.save(map_arrow(both.select("src", "dst", "a", "b"), verify, "src long, dst long"), "verified")
    work.drop(held, wanted)
    return found


def _meeting(similarity: float):
    """Compares the places (node, component, n, last) of one shingle in prefixes: a row for each pair of documents in different components that may
    be similar by their numbers of shingles, with how many shingles of their prefixes it must share.

    Of two prefixes, the one that ends first in the order holds all shared shingles up to its end; so at most as many more are
    shared as this set has behind its prefix.
    """
    share = similarity / (1 + similarity)

    def meet(batch: pa.RecordBatch):
        (ao, a), (bo, b) = ((c.offsets.to_numpy(), [c.values.field(k).to_numpy() for k in range(4)]) for c in (batch.column("a"), batch.column("b")))
        of = np.repeat(np.arange(batch.num_rows), np.diff(ao))
        first, times, own = bo[:-1][of], np.diff(bo)[of], batch.column("own").to_numpy(zero_copy_only=False)[of]
        a = [x[ao[0] : ao[-1]] for x in a]
        step = np.cumsum(times) // PAIRS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(times)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            m = times[x:y]
            i = np.repeat(np.arange(x, y), m)
            j = np.repeat(first[x:y] - np.cumsum(m) + m, m) + np.arange(len(i))
            (p, pc, pn, pl), (q, qc, qn, ql) = ([v[i] for v in a], [v[j] for v in b])
            needed = np.ceil(share * (pn + qn) - 1e-9).astype(np.int64)
            # within a tile both orders of a pair come, of which one is taken
            fits = (~own[i] | (p < q)) & (pc != qc) & (np.minimum(pn, qn) >= needed)
            p, q, pn, qn, pl, ql, needed = (v[fits] for v in (p, q, pn, qn, pl, ql, needed))
            behind = lambda n: np.ceil(similarity * n - 1e-9).astype(np.int64) - 1
            least = needed - np.where(pl == ql, np.minimum(behind(pn), behind(qn)), np.where(pl < ql, behind(pn), behind(qn)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(p, q), np.maximum(p, q), least)], ["src", "dst", "least"])

    return meet


def _unlinked(marked: DataFrame, component: DataFrame, similarity: float, work: Workspace, tile: int = TILE) -> DataFrame:
    """(src, dst): pairs of nodes in different components that may have the similarity; none that has it is left out.

    Two sets with it share a shingle among the first of both (prefix_length) in any order that is one for all. All nodes' prefixes meet by their shingles; where
    these are all of one component nothing is to be done. Pairs that then share too few of their prefixes' shingles go.
    """
    sets = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).where("n > 0")
    sets = sets.join(component.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    places = sets.select("node", "component", "n", F.element_at("prefix", -1).alias("last"), F.explode("prefix").alias("key"))
    own = Window.partitionBy("key")
    met = places.withColumn("several", F.min("component").over(own) != F.max("component").over(own)).withColumn("tiles", F.ceil(F.count("*").over(own) / F.lit(tile)).cast("int")).where("several")
    met = met.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = work.save(met.groupBy("key", "tiles", "tile").agg(F.collect_list(F.struct("node", "component", "n", "last")).alias("items")), "meeting")
    many = tiles.where("tiles > 1").select("key", "tile", "items")
    across = many.select("key", F.col("tile").alias("a_tile"), F.col("items").alias("a")).join(many, "key").where("a_tile < tile").select("a", F.col("items").alias("b"), F.lit(False).alias("own"))
    pairs = tiles.select(F.col("items").alias("a"), F.col("items").alias("b"), F.lit(True).alias("own")).unionByName(across)
    counted = map_arrow(pairs, _meeting(similarity), "src long, dst long, least long").groupBy("src", "dst", "least").agg(F.count("*").alias("shared"))
    return work.save(counted.where("shared >= least").select("src", "dst"), "unlinked")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """The rows of docs that stay when one document of each group of near copies stays, with all their columns.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more are linked; groups are connected
    components. Most links are found between 128-bit fingerprints that differ in ``radius`` bits or fewer: tiles hold
    documents of one class of shingle numbers and bit counts, tiles too far apart in either are skipped, and of each pair of tiles the
    nearest links of a spanning forest are verified. Pairs that this leaves apart are found by the prefixes of their sets and
    verified too, so no link is lost.

    The smallest doc_id of a group stays, in one row; different texts under one id are judged each for itself. A null id is
    larger than any other. Null texts, empty ones and those without a word are one group. An empty table stays empty.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "one-of-each")
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("row"), F.col(text_col).alias("text"))
    frequent = _frequent(source, words)

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, prefixes = [], [np.zeros(0, np.uint64)]
        for t in batch.column("text").to_pylist():
            halves = [_shingle_set(t, words, seed) for seed in (SEED, SEED + 1)]
            n = len(halves[0])
            rows.append((*_wide_fingerprint(halves), n, _content(t)))
            prefixes.append(_ordered(halves[0], frequent)[: prefix_length(n, similarity)])
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        offsets = np.cumsum([len(p) for p in prefixes]).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(c, pa.int64()) for c in columns), prefix], ["doc_id", "row", "w0", "w1", "n", "content", "prefix"])

    marked = map_arrow(source, mark, "doc_id long, row long, w0 long, w1 long, n long, content long, prefix array<long>")
    marked = work.save(marked.withColumn("node", F.xxhash64("content", "w0", "w1", "n")).drop("content"), "marks")
    repeated = work.save(marked.groupBy("doc_id", "row").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")), "repeated")
    again = not repeated.isEmpty()
    length = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(-math.log(similarity))).cast("long")
    # cells are so wide that fingerprints within the radius lie in the same or in the next one
    count = F.floor((F.bit_count("w0") + F.bit_count("w1")) / F.lit(radius + 1)).cast("long")
    across = 128 // (radius + 1) + 3
    distinct = work.save(marked.groupBy("node", "w0", "w1", "n").agg(F.count("*").alias("rows")), "distinct")
    tiles = _tiles(distinct.select(F.col("node").alias("id"), "w0", "w1", (length * across + count + 1).alias("cell")), 2, tile, work)
    left = tiles.select(F.explode(F.array(*(F.col("cell") + d for d in (0, 1, across - 1, across, across + 1)))).alias("cell"), F.col("cell").alias("a_cell"), F.col("tile").alias("a_tile"), F.col("items").alias("a"))
    pairs = left.join(tiles, "cell").where("a_cell <> cell or a_tile <= tile").select("a", F.col("items").alias("b"))
    found = work.save(_compared(pairs, radius, 2).distinct(), "links")
    near = _verified(found, source, marked, words, similarity, work, again)
    component = work.save(connected_components(near, work), "components")
    more = _verified(_unlinked(marked, component, similarity, work, tile), source, marked, words, similarity, work, again)
    if not more.isEmpty():
        component = work.save(connected_components(near.unionByName(more), work), "components")
    groups = marked.select("doc_id", "row", "node").join(component, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("group"))
    groups = work.save(groups, "groups")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    stays = work.save(groups.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("group", "first.doc_id", "first.row"), "stays")
    other = ~(groups["doc_id"].eqNullSafe(stays["doc_id"]) & (groups["row"] == stays["row"]))
    gone = work.save(groups.join(stays, "group").where(other).select(groups["doc_id"].alias("__id"), groups["row"].alias("__row")).distinct(), "gone")
    keyed = docs.withColumn("__row", key)
    gone = gone.hint("merge")
    rest = keyed.join(gone, F.col(id_col).cast("long").eqNullSafe(gone["__id"]) & (keyed["__row"] == gone["__row"]), "left_anti")
    if not again:
        return rest.select(docs.columns)
    same = F.col(id_col).cast("long").eqNullSafe(repeated["__id"]) & (rest["__row"] == repeated["__row"])
    once = rest.join(repeated, same, "left_semi").dropDuplicates([id_col, "__row"])
    return rest.join(repeated, same, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over fingerprints within the radius.

    Null, empty and white-space texts have the fingerprint zero and are linked like any other. Repeated rows are
    returned as often as they come. A null doc_id is kept and never becomes a component_id, unless the component has no
    other. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "simhash")
    marked = work.save(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = work.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = links(distinct, radius, work, tile, blocks)
    component = connected_components(found, work).select(F.col("node").alias("fp"), "component")
    rooted = work.save(distinct.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "rooted")
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = work.save(rooted.join(least, "component").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
