"""A knowledge graph as two tables: nodes (name, papers) and edges (head, relation, tail, paper), parallel edges as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import json_array, norm_key, paper_of
from tessera.operators.components import connected_components
from tessera.operators.vector_index import similar_links
from tessera.storage import Workspace

#: Spellings of known entities, types that are kept, names that are no entity.
ALIASES = {
    "CLIP": ["clip", "clip-vit-b-32", "contrastive language-image pre-training", "contrastive language image pretraining"],
    "GNN": ["gnn", "graph neural networks", "graph neural network", "图神经网络", "graphneuralnetworks"],
    "Transformer": ["transformer", "transformers"],
}
TYPES = ("模型", "方法", "任务", "概念", "数据集", "指标", "技术")
STOP_ENTITIES = ("本文", "我们", "已有方法", "现有方法", "该方法", "方法", "模型", "提出的方法", "本方法", "作者", "论文", "该模型")
TRIPLE = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>"


def parse_triples(replies: DataFrame, most: int = 12) -> DataFrame:
    """replies (source_id, reply) -> (source_id, head, head_type, relation, tail, tail_type); incomplete ones are dropped."""
    complete = lambda t: (F.coalesce(t["head"], F.lit("")) != "") & (F.coalesce(t["relation"], F.lit("")) != "") & (F.coalesce(t["tail"], F.lit("")) != "")
    rows = F.slice(F.filter(json_array(F.col("reply"), TRIPLE), complete), 1, most)
    return replies.select("source_id", F.explode(rows).alias("t")).select("source_id", "t.*")


def alias_table(spark, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(key, canonical) of every known spelling."""
    rows = [(v, name) for name, spellings in aliases.items() for v in [name, *spellings]]
    return spark.createDataFrame(rows, "spelling string, canonical string").select(norm_key(F.col("spelling")).alias("key"), "canonical").distinct()


def keep_research(triples: DataFrame) -> DataFrame:
    """Triples without stop entities; where any triple has a type, both types must be known ones or empty."""
    typed = triples.agg(F.coalesce(F.max(F.col("head_type").isNotNull()), F.lit(False)).alias("typed"))
    known = lambda c: ~F.col("typed") | (F.coalesce(c, F.lit("")) == "") | F.col(c).isin(*TYPES)
    kept = triples.crossJoin(F.broadcast(typed)).where(~F.col("head").isin(*STOP_ENTITIES) & ~F.col("tail").isin(*STOP_ENTITIES) & known("head_type") & known("tail_type"))
    return kept.drop("typed")


def canonical_names(triples: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(surface, canonical): spellings with one key have one name, the alias's or else the most frequent, of equally
    frequent ones the one that comes first in the order of (source_id, head, tail)."""
    order = F.struct("source_id", "head", "tail")
    ends = triples.select(F.explode(F.array(F.struct(F.col("head").alias("surface"), order.alias("seen"), F.lit(0).alias("end")), F.struct(F.col("tail").alias("surface"), order.alias("seen"), F.lit(1).alias("end")))).alias("e")).select("e.*")
    counted = ends.groupBy("surface").agg(F.count("*").alias("n"), F.min(F.struct("seen", "end")).alias("first")).withColumn("key", norm_key(F.col("surface")))
    best = counted.groupBy("key").agg(F.min_by("surface", F.struct(-F.col("n"), "first")).alias("mode"))
    named = best.join(aliases, "key", "left") if aliases is not None else best.withColumn("canonical", F.lit(None).cast("string"))
    return counted.join(named.select("key", F.coalesce("canonical", "mode").alias("canonical")), "key").select("surface", "canonical")


def merge_similar(names: DataFrame, threshold: float = 0.9) -> DataFrame:
    """names (name, embedding) -> (name, canonical): components of the graph of names whose cosine reaches the threshold;
    the shortest name stands for each. Names without a vector stand alone."""
    work = Workspace(names.sparkSession, "merge-similar")
    # names with one vector are alike before any comparison, so that a large group of them isn't compared in pairs
    keyed = work.save(names.select(F.xxhash64(F.coalesce(F.col("embedding").cast("string"), F.col("name"))).alias("vec_id"), "name", "embedding"), "names")
    distinct = work.save(keyed.groupBy("vec_id").agg(F.any_value("embedding").alias("embedding")), "vectors")
    found = connected_components(similar_links(distinct, threshold, work), work)
    joined = keyed.join(found, keyed["vec_id"] == found["node"], "left").withColumn("component", F.coalesce("component", "vec_id"))
    shortest = joined.groupBy("component").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("canonical"))
    return joined.join(shortest, "component").select("name", "canonical")


def build_graph(triples: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples (source_id, head, relation, tail), under their canonical names."""
    edges = (
        triples.join(names.select(F.col("surface").alias("head"), F.col("canonical").alias("h")), "head")
        .join(names.select(F.col("surface").alias("tail"), F.col("canonical").alias("t")), "tail")
        .select(F.col("h").alias("head"), "relation", F.col("t").alias("tail"), paper_of(F.col("source_id")).alias("paper"))
    )
    ends = edges.select(F.explode(F.array("head", "tail")).alias("name"), "paper")
    return ends.groupBy("name").agg(F.sort_array(F.collect_set("paper")).alias("papers")), edges


def counts(triples: DataFrame) -> DataFrame:
    """One row: n_triples, n_entities, n_relations, n_chunks of triples (source_id, head, relation, tail), names as they are."""
    of = triples.agg(F.count("*").alias("n_triples"), F.countDistinct("relation").alias("n_relations"), F.countDistinct("source_id").alias("n_chunks"))
    entities = triples.select(F.explode(F.array("head", "tail")).alias("name")).agg(F.countDistinct("name").alias("n_entities"))
    return of.crossJoin(entities).select("n_triples", "n_entities", "n_relations", "n_chunks")


def degrees(edges: DataFrame) -> DataFrame:
    """(name, degree): edges in and out, parallel ones each, a self-loop twice."""
    return edges.select(F.explode(F.array("head", "tail")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def bridges(edges: DataFrame) -> DataFrame:
    """(name, n_papers) of the entities in more than one paper."""
    ends = edges.select(F.explode(F.array("head", "tail")).alias("name"), "paper")
    return ends.groupBy("name").agg(F.countDistinct("paper").alias("n_papers")).where("n_papers > 1")


def hub_neighbours(edges: DataFrame, hub: str | None = None) -> DataFrame:
    """(hub, direction, relation, name): the distinct relations of one entity with others, out of it and into it. Without a name the
    hub is the entity with most edges, of equals the first by name. An unknown hub has no rows."""
    if hub is None:
        one = degrees(edges).orderBy(F.col("degree").desc(), "name").limit(1).select(F.col("name").alias("hub"))
    else:
        one = edges.sparkSession.createDataFrame([(hub,)], "hub string")
    side = lambda direction, own, other: edges.select(F.col(own).alias("hub"), F.lit(direction).alias("direction"), "relation", F.col(other).alias("name"))
    return side("out", "head", "tail").unionByName(side("in", "tail", "head")).join(F.broadcast(one), "hub").distinct()


def link_entities(queries: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(query_id, name): nodes whose key, or an alias's key, lies in the query's key; longer names first by ``place``.

    Keys are looked up by equality: every substring of a query's key, as long as some node's key is, is joined to the nodes.
    """
    keys = nodes.select("name", norm_key(F.col("name")).alias("key"))
    if aliases is not None:
        keys = keys.unionByName(aliases.select(F.col("canonical").alias("name"), "key").join(nodes.select("name"), "name", "left_semi"))
    keys = keys.where(F.length("key") >= least).distinct()
    asked = queries.select("query_id", norm_key(F.col("question")).alias("q"))
    lengths = F.broadcast(keys.agg(F.sort_array(F.collect_set(F.length("key"))).alias("lengths")))
    pieces = F.explode(F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.when(F.length("q") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("q") - n + 1, F.lit(1))), lambda i: F.substring("q", i, n))).otherwise(F.array().cast("array<string>"))))))
    found = asked.crossJoin(lengths).select("query_id", pieces.alias("key")).join(keys, "key").select("query_id", "name").distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("name").desc(), "name")))


def gather_facts(edges: DataFrame, entities: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, hop, head, relation, tail, paper): the edges within ``hops`` steps of each query's entities (query_id,
    name), in both directions; a fact counts once, at its first hop, with its first paper."""
    work = Workspace(edges.sparkSession, "facts")
    visited = work.save(entities.select("query_id", "name", F.lit(1).alias("hop")).distinct(), "frontier")
    frontier, found = visited, None
    for hop in range(1, hops + 1):
        touched = edges.withColumn("name", F.explode(F.array_distinct(F.array("head", "tail")))).join(frontier.select("query_id", "name"), "name")
        facts = touched.select("query_id", F.lit(hop).alias("hop"), "head", "relation", "tail", "paper")
        found = facts if found is None else found.unionByName(facts)
        if hop < hops:
            after = facts.select("query_id", F.explode(F.array("head", "tail")).alias("name")).distinct().join(visited, ["query_id", "name"], "left_anti")
            frontier = work.save(after.withColumn("hop", F.lit(hop + 1)), "frontier")
            visited = visited.unionByName(frontier)
    first = found.groupBy("query_id", "head", "relation", "tail").agg(F.min(F.struct("hop", "paper")).alias("f"))
    return first.select("query_id", F.col("f.hop").alias("hop"), "head", "relation", "tail", F.col("f.paper").alias("paper"))


def community_facts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, head, relation, tail): edges whose ends are two members of one community."""
    a = members.select(F.col("community"), F.col("name").alias("head"))
    b = members.select(F.col("community"), F.col("name").alias("tail"))
    return edges.where("head <> tail").join(a, "head").join(b, ["community", "tail"]).select("community", "head", "relation", "tail")
