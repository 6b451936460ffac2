"""Retrieval metrics, run comparison, percentiles and significance tests, over long tables keyed by query."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import dedupe_sources

KS = (1, 3, 5, 10)


def _ideal(n: Column) -> Column:
    """Discounted gain of n correct results in the first n places."""
    gains = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= n, 1.0 / F.log2(i + F.lit(1.0))).otherwise(F.lit(0.0)))
    return F.aggregate(gains, F.lit(0.0), lambda s, g: s + g)


def rank_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, dedupe: bool = True) -> DataFrame:
    """(query_id, first_rank, mrr, hit@k, recall@k, ndcg@k ...), one row for each query of gold (query_id, source_id).

    hits: (query_id, rank, source_id). With ``dedupe`` a document counts at its first place only and ranks are closed up,
    so that ndcg stays at 1 or below; without it ranks are those of chunks. A query without hits has zeros and no rank.
    """
    ranked = dedupe_sources(hits) if dedupe else hits.select("query_id", "source_id", "rank")
    expected = gold.select("query_id", "source_id").distinct()
    n = expected.groupBy("query_id").agg(F.count("source_id").alias("n"))
    right = ranked.join(expected, ["query_id", "source_id"])
    gain = 1.0 / F.log2(F.col("rank") + F.lit(1.0))
    found = [F.min("rank").alias("first_rank")]
    for k in ks:
        inside = F.col("rank") <= k
        # gains are added up by rank, so that equal places give equal sums to the last bit, and runs tie
        gains = F.array_sort(F.collect_list(F.when(inside, F.struct("rank", gain.alias("gain")))))
        found += [F.countDistinct(F.when(inside, F.col("source_id"))).alias(f"n{k}"), F.aggregate(gains, F.lit(0.0), lambda s, g: s + g["gain"]).alias(f"dcg{k}")]
    per = n.join(right.groupBy("query_id").agg(*found), "query_id", "left")
    out = ["query_id", "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        hit = F.coalesce(F.col(f"n{k}"), F.lit(0))
        ideal = _ideal(F.least(F.col("n"), F.lit(k)).cast("int"))
        out += [
            F.when(hit > 0, 1.0).otherwise(0.0).alias(f"hit@{k}"),
            F.when(F.col("n") > 0, hit / F.col("n")).otherwise(0.0).alias(f"recall@{k}"),
            F.when(F.col("n") > 0, F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / ideal).otherwise(0.0).alias(f"ndcg@{k}"),
        ]
    return per.select(*out)


def long(metrics: DataFrame, stage: str) -> DataFrame:
    """(stage, query_id, metric, value) of a table of rank_metrics."""
    names = [c for c in metrics.columns if c not in ("query_id", "first_rank")]
    return metrics.select(F.lit(stage).alias("stage"), "query_id", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in names))).alias("m")).select("stage", "query_id", "m.metric", "m.value")


def mean_metrics(values: DataFrame) -> DataFrame:
    """(stage, metric, mean, n): nulls count as 0."""
    return values.groupBy("stage", "metric").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"), F.count("*").alias("n"))


def leaderboard(runs: DataFrame, metric: str = "recall@5", stage: str = "hybrid_rerank") -> DataFrame:
    """The latest run (by seq) of each label and query set, best first. runs: label, eval_set, seq, stage, metric, mean."""
    latest = runs.groupBy("label", "eval_set").agg(F.max("seq").alias("seq"))
    rows = runs.where((F.col("metric") == metric) & (F.col("stage") == stage)).join(latest, ["label", "eval_set", "seq"])
    order = Window.partitionBy("eval_set").orderBy(F.col("mean").desc(), "label")
    return rows.select("eval_set", F.row_number().over(order).alias("place"), "label", "seq", "mean")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, n, mean_a, mean_b, wins, ties, losses) over the queries that both runs (query_id, metric, value) have."""
    both = a.select("query_id", "metric", F.col("value").alias("x")).join(b.select("query_id", "metric", F.col("value").alias("y")), ["query_id", "metric"])
    return both.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"),
        F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"),
    )


def run_values(values: DataFrame, label: str, stage: str, metric: str) -> tuple[str, DataFrame]:
    """(query set, (query_id, metric, value)) of the last run of a label, from the logged values (seq, label, eval_set, stage, query_id,
    metric, value). A ValueError says so if there is no such run, if some query of it has no values for the stage (old logs
    don't have them), or if the stage hasn't the metric. A null value counts as 0."""
    of_label = values.where(F.col("label") == label)
    last = of_label.agg(F.max("seq").alias("seq"), F.max_by("eval_set", "seq").alias("eval_set")).first()
    if last.seq is None:
        raise ValueError(f"no run has the label {label!r}")
    run = of_label.where(F.col("seq") == last.seq)
    at_stage = F.col("stage") == stage
    n = run.agg(F.count_distinct("query_id").alias("all"), F.count_distinct(F.when(at_stage, F.col("query_id"))).alias("some"), F.collect_set(F.when(at_stage, F.col("metric"))).alias("metrics")).first()
    if n.some < n.all:
        raise ValueError(f"run {label!r} has no values for stage {stage!r} in {n.all - n.some} of {n.all} queries; run it again")
    if metric not in n.metrics:
        raise ValueError(f"run {label!r} has no metric {metric!r}, but {sorted(n.metrics)}")
    found = run.where(at_stage & (F.col("metric") == metric)).select("query_id", "metric", F.coalesce("value", F.lit(0.0)).alias("value"))
    return last.eval_set, found


def compare_labels(values: DataFrame, a: str, b: str, stage: str = "hybrid_rerank", metric: str = "recall@5") -> DataFrame:
    """compare() of the last runs of two labels; runs over different query sets are a ValueError."""
    (set_a, run_a), (set_b, run_b) = (run_values(values, label, stage, metric) for label in (a, b))
    if set_a != set_b:
        raise ValueError(f"the runs have different query sets: {set_a!r} and {set_b!r}")
    return compare(run_a, run_b)


def flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """The queries whose values differ, with the difference a - b."""
    both = a.select("query_id", "metric", F.col("value").alias("a")).join(b.select("query_id", "metric", F.col("value").alias("b")), ["query_id", "metric"])
    return both.where("a <> b").withColumn("diff", F.col("a") - F.col("b"))


def nearest_rank_percentile(values: DataFrame, keys: tuple[str, ...], value: str, p: float) -> DataFrame:
    """The value at index round(p/100 * (n - 1)), halves to the even index; nulls are left out.

    Approximate percentiles on either side, whose error is a known share of n, leave a small part of each key's values; only
    these are counted by value and put in order, however many rows a key has.
    """
    share, near = p / 100.0, 0.002
    given = values.where(F.col(value).isNotNull())
    around = F.percentile_approx(value, [max(0.0, share - near), min(1.0, share + near)], int(10 / near))
    bounds = given.groupBy(*keys).agg(F.count("*").alias("__n"), around.alias("__around"))
    bounds = bounds.select(*keys, F.rint(F.lit(share) * (F.col("__n") - 1)).alias("__place"), F.col("__around")[0].alias("__low"), F.col("__around")[1].alias("__high"))
    placed = given.join(bounds, list(keys))
    low, high = (F.lit(False) if share <= near else F.col(value) < F.col("__low")), (F.lit(False) if share >= 1 - near else F.col(value) > F.col("__high"))
    # what lies below goes as one row into the counts of what lies between
    counted = placed.where(~high).groupBy(*keys, "__place", F.when(~low, F.col(value)).alias(value)).agg(F.count("*").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first()))
    found = counted.withColumn("__upto", upto).where((F.col("__place") < F.col("__upto")) & (F.col("__place") >= F.col("__upto") - F.col("__m")))
    return found.select(*keys, F.col(value).alias(f"p{p:g}"))


def recent_percentile(values: DataFrame, keys: tuple[str, ...], value: str, ts: str, p: float, recent: int = 1000) -> DataFrame:
    """The value at index int(p/100 * n) of each key's last ``recent`` rows by ts. The limit acts before rows are shuffled."""
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(value))
    last = values.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= recent)
    ordered = last.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__v"))
    place = F.least(F.floor(F.lit(p / 100.0) * F.size("__v")), F.size("__v") - 1).cast("int")
    return ordered.select(*keys, F.get("__v", place).alias(f"p{p:g}"))


#: Resamples that one row stands for; a group's resamples are dealt out in blocks of this size.
BLOCK = 500


def _blocks(groups: DataFrame, n: int) -> DataFrame:
    """groups, once for each block of n resamples: columns block and size."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-n // BLOCK) - 1))), lambda b: F.struct(b.alias("block"), F.least(F.lit(BLOCK), F.lit(n) - b * BLOCK).alias("size")))
    return groups.select("*", F.explode(blocks).alias("__b")).select(*groups.columns, "__b.block", "__b.size").repartition("block")


def _generator(seed: int, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, block])


def bootstrap(values: DataFrame, keys: tuple[str, ...] = ("stage", "metric"), resamples: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(keys, mean, low, high): a percentile interval of each group's mean. Values are taken in the order of query_id and null
    ones as 0; resamples come from a generator seeded by seed and block, so that a result doesn't depend on the cluster."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("query_id", F.coalesce("value", F.lit(0.0)).alias("value")))), lambda x: x["value"])
    groups = values.groupBy(*keys).agg(ordered.alias("v"))

    @F.pandas_udf("array<double>")
    def means(v: pd.Series, block: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([x[_generator(seed, b).integers(0, len(x), (n, len(x)))].mean(axis=1).tolist() for x, b, n in zip(v, block, size, strict=True)])

    drawn = _blocks(groups, resamples).select(*keys, means("v", "block", "size").alias("m"))
    sorted_ = drawn.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("m"))).alias("m"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    at = lambda share: F.get("m", F.lit(min(resamples - 1, int(share * resamples)))).alias("low" if share < 0.5 else "high")
    return groups.select(*keys, mean.alias("mean")).join(sorted_, list(keys)).select(*keys, "mean", at(alpha / 2), at(1 - alpha / 2))


def permutation_test(a: DataFrame, b: DataFrame, permutations: int = 10_000, seed: int = 0) -> DataFrame:
    """(metric, mean_diff, p_value) of two runs over their common queries: a two-sided test by seeded sign flips, with one added to
    both counts. p is 1 if nothing differs."""
    both = a.select("query_id", "metric", F.col("value").alias("x")).join(b.select("query_id", "metric", F.col("value").alias("y")), ["query_id", "metric"])
    differences = F.transform(F.array_sort(F.collect_list(F.struct("query_id", (F.col("x") - F.col("y")).alias("d")))), lambda r: r["d"])
    groups = both.groupBy("metric").agg(differences.alias("d"))

    @F.pandas_udf("long")
    def extreme(d: pd.Series, block: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for x, k, n in zip(d, block, size, strict=True):
            signs = _generator(seed, k).integers(0, 2, (n, len(x)), dtype=np.int8) * 2.0 - 1.0
            out.append(int((np.abs(signs @ x) >= abs(x.sum()) - 1e-12 * len(x)).sum()))
        return pd.Series(out)

    counted = _blocks(groups, permutations).select("metric", extreme("d", "block", "size").alias("n")).groupBy("metric").agg(F.sum("n").alias("extreme"))
    total, differs = F.aggregate("d", F.lit(0.0), lambda s, x: s + x), F.exists("d", lambda x: x != 0)
    p = F.when(differs, (F.col("extreme") + 1) / F.lit(permutations + 1)).otherwise(1.0)
    return groups.join(counted, "metric").select("metric", F.when(differs, total / F.size("d")).otherwise(0.0).alias("mean_diff"), p.alias("p_value"))


class NotExact(ValueError):
    """So many differences, on so fine a scale, that their sign flips can't be counted exactly."""


#: Decimals at which sums are told apart; distinct sums that are counted one by one; differences whose sums are listed in halves.
DECIMALS, MOST_SUMS, MOST_LISTED = 9, 1 << 24, 44


def _sums(values: np.ndarray) -> np.ndarray:
    """The sums of all sign flips, in order."""
    sums = np.zeros(1, np.int64)
    for v in values:
        low, high = sums - v, sums + v
        sums = np.sort(np.concatenate([low, high]), kind="stable")  # two sorted runs: one merge
    return sums


def exact_p(differences: np.ndarray) -> float:
    """Share of all sign flips whose sum is as far from 0 as that of the differences. Sums are whole multiples of 10**-DECIMALS.

    Differences on a common scale, as those of metrics are, have few distinct sums: their distribution is built up one
    difference after the other. Others are cut into halves, whose sums are listed, and pairs of sums counted by binary search, so that
    2**(n/2) sums stand for 2**n. NotExact is raised where neither will do.
    """
    whole = [abs(int(v)) for v in np.rint(np.asarray(differences, np.float64) * 10**DECIMALS)]
    least, values = abs(int(np.rint(np.asarray(differences, np.float64) * 10**DECIMALS).sum())), [v for v in whole if v]
    if not values or least == 0:
        return 1.0
    unit = math.gcd(*values)
    values, least = sorted((v // unit for v in values), reverse=True), least // unit
    total = sum(values)
    if total <= MOST_SUMS and total * len(values) <= MOST_SUMS << 10:
        share = np.zeros(2 * total + 1)
        share[total] = 1.0
        reach = 0
        for v in values:
            before = share[total - reach : total + reach + 1] / 2
            share[total - reach : total + reach + 1] = 0
            share[total - reach - v : total + reach - v + 1] += before
            share[total - reach + v : total + reach + v + 1] += before
            reach += v
        return float(min(1.0, share[: total - least + 1].sum() + share[total + least :].sum()))
    if len(values) > MOST_LISTED or total >= 1 << 62:
        raise NotExact(f"{len(values)} differences with {2 * total + 1} possible sums")
    a, b = _sums(np.array(values[::2], np.int64)), _sums(np.array(values[1::2], np.int64))
    # sums are symmetric around 0, so those of -least or less are as many as those of least or more
    far = sum(int((len(b) - np.searchsorted(b, least - part, side="left")).sum()) for part in np.array_split(a, max(1, len(a) >> 18)))
    return min(1.0, 2 * far / 2 ** len(values))


def exact_permutation(differences: DataFrame, keys: tuple[str, ...], value: str = "diff") -> DataFrame:
    """(keys, n, mean_diff, p_value): all 2**n sign flips of each group's differences, without sampling: any number of differences on a
    common scale (up to 2**24 distinct sums), up to 44 others; beyond both the job fails with NotExact. Nulls are left out."""
    groups = differences.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("d"))

    @F.pandas_udf("double")
    def p_value(d: pd.Series) -> pd.Series:
        return d.map(exact_p)

    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    return groups.select(*keys, F.size("d").alias("n"), (total / F.size("d")).alias("mean_diff"), p_value("d").alias("p_value"))


def token_cost(usage: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """(trace_id, prompt_tokens, completion_tokens, cost) from usage (trace_id, model, prompt_tokens, completion_tokens)
    and prices a million tokens (model, prompt_price, completion_price); unknown models have the default prices."""
    priced = usage.join(prices, "model", "left").fillna({"prompt_price": default[0], "completion_price": default[1]})
    cost = (F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")) / 1e6
    return priced.groupBy("trace_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(cost).alias("cost"))
