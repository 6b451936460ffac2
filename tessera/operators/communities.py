"""Communities of an undirected graph by modularity, as joins and aggregates.

Nodes move, in rounds, to the neighbouring community that gains most; a hashed half of them may move in a round, so that neighbours
don't swap for ever, and a round counts only if it raises modularity. When none does, communities become the nodes of a smaller
graph, until that doesn't shrink any more. All weights are whole numbers, so results don't depend on the order of sums; ties go to the
smaller name. Nothing but sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import Workspace

#: Rounds in a row, one for each half of the nodes in two divisions, that may fail before a level ends, and the least gain in modularity of one that doesn't.
TRIES, LEAST_GAIN = 4, 2e-3


def undirected(edges: DataFrame, src: str = "head", dst: str = "tail") -> DataFrame:
    """(a, b), a < b: each pair of linked nodes once, without self-loops and null ends."""
    ends = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), (F.col(src) != F.col(dst)).alias("differ"))
    return ends.where("differ").select("a", "b").distinct()


def modularity(edges: DataFrame, members: DataFrame, src: str = "head", dst: str = "tail") -> DataFrame:
    """One row (n_edges, n_inside, n_communities, modularity) of a partition (community, name) of the graph's nodes; a node that isn't
    in it is a community of its own. No edges give a modularity of null."""
    work = Workspace(edges.sparkSession, "modularity")
    pairs = work.save(undirected(edges, src, dst), "pairs")
    of = lambda end: members.select(F.col("name").alias(end), F.struct("community", F.lit(None).alias("own")).alias(f"c_{end}"))
    alone = lambda end: F.coalesce(F.col(f"c_{end}"), F.struct(F.lit(None).alias("community"), F.col(end).alias("own")))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(alone("a").alias("x"), alone("b").alias("y"))
    placed = work.save(placed, "placed")
    total = placed.agg(F.count("*").alias("n_edges"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("n_inside"))
    degrees = placed.select(F.explode(F.array("x", "y")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    squares = degrees.agg(F.count("*").alias("n_communities"), F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    q = F.col("n_inside") / F.col("n_edges") - F.col("squares") / (4.0 * F.col("n_edges") * F.col("n_edges"))
    return total.crossJoin(squares).select("n_edges", "n_inside", "n_communities", F.when(F.col("n_edges") > 0, q).alias("modularity"))


class _Level:
    """One graph: links (a, b, w) in both directions, self-loops twice their weight."""

    def __init__(self, links: DataFrame, weight: int, work: Workspace, part: DataFrame | None = None):
        """part: (node, c) to start from; else each node is a community."""
        self.links, self.weight, self.work = links, weight, work
        degrees = links.groupBy("a").agg(F.sum("w").alias("k")).select(F.col("a").alias("node"), "k")
        placed = degrees.join(part, "node") if part is not None else degrees.withColumn("c", F.col("node"))
        self.part = work.save(placed.select("node", "k", "c"), "part")
        self.score = self._score(self.part)

    def _score(self, part: DataFrame) -> int:
        """Modularity times the square of the sum of all weights."""
        of = lambda end: part.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
        inside = self.links.join(of("a"), "a").join(of("b"), "b").where("c_a = c_b").agg(F.sum("w").alias("inside"))
        totals = part.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k").cast("decimal(38,0)") * F.col("k")).alias("squares"))
        row = inside.crossJoin(totals).first()
        return self.weight * int(row["inside"] or 0) - int(row["squares"] or 0)

    def move(self, round_: int) -> bool:
        """Moves nodes of this round's half to where they gain most, if modularity rises by that; False if it does hardly or not."""
        totals = self.work.save(self.part.groupBy("c").agg(F.sum("k").alias("total")), "totals")
        others = self.links.where("a <> b").join(self.part.select(F.col("node").alias("b"), "c"), "b")
        near = self.work.save(others.groupBy("a", "c").agg(F.sum("w").alias("w")), "near")
        movers = self.part.where(F.pmod(F.xxhash64("node", F.lit(round_ // 2)) + F.lit(round_), F.lit(2)) == 0).select(F.col("node").alias("a"), "k", F.col("c").alias("own"))
        # staying is a choice too, with the links into the own community or none
        choices = near.join(movers, "a").unionByName(movers.select("a", F.col("own").alias("c"), F.lit(0).cast("long").alias("w"), "k", "own"))
        merged = choices.groupBy("a", "c", "k", "own").agg(F.sum("w").alias("w")).join(totals, "c")
        stays = F.col("c") == F.col("own")
        gain = F.col("w") * F.lit(self.weight).cast("decimal(20,0)") - F.col("k").cast("decimal(20,0)") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0))
        best = merged.groupBy("a").agg(F.min_by("c", F.struct(-gain, F.when(stays, 0).otherwise(1), "c")).alias("to"))
        moved = self.part.join(best.withColumnRenamed("a", "node"), "node", "left").select("node", "k", F.coalesce("to", "c").alias("c"))
        moved = self.work.save(moved, "part")
        self.work.drop(totals, near)
        score = self._score(moved)
        if score <= self.score:
            self.work.drop(moved)
            return False
        gained = (score - self.score) / self.weight**2
        self.part, self.score = moved, score
        return gained >= LEAST_GAIN

    def settle(self) -> None:
        failed = round_ = 0
        while failed < TRIES:
            failed = 0 if self.move(round_) else failed + 1
            round_ += 1

    def contracted(self) -> DataFrame:
        of = lambda end: self.part.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
        joined = self.links.join(of("a"), "a").join(of("b"), "b")
        return joined.groupBy(F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.sum("w").alias("w"))


def _climb(links: DataFrame, weight: int, part: DataFrame | None, work: Workspace) -> tuple[DataFrame, int]:
    """(node, c) and its score: nodes move on the graph itself, then on ever smaller ones, until one doesn't shrink."""
    found = None
    while True:
        level = _Level(links, weight, work, part)
        level.settle()
        step, part = level.part.select("node", "c"), None
        found = step if found is None else work.save(found.join(step.select(F.col("node").alias("c"), F.col("c").alias("up")), "c").select("node", F.col("up").alias("c")), "found")
        if weight == 0 or level.part.count() == level.part.select("c").distinct().count():
            return found, level.score
        links = work.save(level.contracted(), "links")


def communities(edges: DataFrame, least: int = 2, src: str = "head", dst: str = "tail") -> DataFrame:
    """(community, name): a partition of high modularity of the simple undirected graph of edges (src, dst); ``community`` is its
    smallest name, and communities of fewer than ``least`` names are left out. What a climb finds is where the next one starts,
    with single nodes again, as long as modularity rises. Self-loops, repeated edges and null ends don't count. An empty graph gives an
    empty table."""
    work = Workspace(edges.sparkSession, "communities")
    pairs = work.save(undirected(edges, src, dst), "pairs")
    weight = 2 * pairs.count()
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("w", F.lit(1).cast("long"))
    links = work.save(links, "links")
    found, score = _climb(links, weight, None, work)
    while weight:
        again, higher = _climb(links, weight, found, work)
        if higher - score <= LEAST_GAIN * weight**2:
            break
        found, score = again, higher
    named = work.save(found.groupBy("c").agg(F.min("node").alias("community"), F.count("*").alias("n")).where(F.col("n") >= least), "named")
    return found.join(named, "c").select("community", F.col("node").alias("name"))
