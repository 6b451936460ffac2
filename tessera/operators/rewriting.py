"""Query rewriting in three layers: rules, a pluggable model, keywords. All work on a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import replace_all, strip

#: Colloquial terms and the standard terms that are added for them.
SYNONYMS = {
    "拉肚子": "腹泻", "跑肚": "腹泻", "拉稀": "腹泻", "发烧": "发热", "低烧": "低热", "高烧": "高热", "心慌": "心悸", "心脏不舒服": "心悸 胸闷",
    "喘不上气": "呼吸困难 气促", "气短": "呼吸困难", "上不来气": "呼吸困难", "肚子疼": "腹痛", "肚子痛": "腹痛", "胃疼": "胃痛 上腹痛", "头疼": "头痛",
    "嗓子疼": "咽痛", "没劲": "乏力", "浑身没劲": "乏力", "瘦了": "消瘦 体重下降", "眼睛黄": "黄疸", "皮肤黄": "黄疸", "起夜": "夜尿增多", "尿多": "多尿",
    "脚趾疼": "关节痛", "关节疼": "关节痛", "长水疱": "疱疹", "起红疹": "皮疹", "起疹子": "皮疹", "怕冷": "畏寒", "怕热": "怕热 多汗",
}
#: Words that keywords leave out.
STOP_WORDS = (
    "的 了 吗 呢 啊 是 在 和 与 或 我 你 他 它 会 不 会不会 是不是 有没有 怎么 怎样 如何 哪些 哪个 什么 为什么 需要 应该 可能 一般 通常 请问 谢谢 吧 "
    "这个 那个 一下 可以 能 要 做 看 挂 该"
).split()
PUNCTUATION = "[，。？！、；：,.?!;:\\s]+"


def add_terms(query: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The query with the standard terms of the colloquial ones it has behind it; terms that it has already are left out."""
    found = F.flatten(F.array(*(F.when(F.contains(query, F.lit(k)), F.array(*(F.lit(t) for t in v.split()))).otherwise(F.array().cast("array<string>")) for k, v in synonyms.items())))
    extra = F.array_distinct(F.filter(found, lambda t: ~F.contains(query, t)))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


def keywords(query: Column, stop_words: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """Punctuation and stop words, longest first, become spaces; a query of nothing else stays as it is."""
    bare = replace_all(F.regexp_replace(query, PUNCTUATION, " "), sorted(stop_words, key=lambda w: (-len(w), w)))
    words = strip(F.regexp_replace(bare, r"\s+", " "))
    return F.when(words != "", words).otherwise(query)


def history_block(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, history): the turns of each conversation in order, one on a line under a heading."""
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("turns"))
    return rows.select(key, F.concat(F.lit("对话历史：\n"), F.array_join("turns.t", "\n"), F.lit("\n\n")).alias("history"))


def retrieval_queries(queries: DataFrame, rules: bool = False, nlp: bool = False, mode: str = "none", model: Callable[[Column], Column] | None = None, variants: int = 3) -> DataFrame:
    """queries (query_id, question) -> (query_id, spec_no, vector_text, bm25_text).

    mode: none, rewrite, hyde or multi; ``model`` is a column function that stands for a language model and gives one
    text, or for multi one variant on a line.
    """
    base = add_terms(F.col("question")) if rules else F.col("question")
    if mode != "none" and model is None:
        raise ValueError(f"{mode} needs a model")
    rows = queries.select("query_id", base.alias("base"))
    if mode == "rewrite":
        rows = rows.withColumn("base", F.coalesce(F.nullif(strip(model(F.col("base"))), F.lit("")), F.col("base")))
    if mode == "multi":
        lines = F.filter(F.transform(F.split(model(F.col("base")), "\n"), lambda x: F.regexp_replace(x, r"^[ \-·•\t]+|[ \-·•\t]+$", "")), lambda x: x != "")
        specs = rows.select("query_id", F.posexplode(F.concat(F.array("base"), F.slice(lines, 1, variants))).alias("spec_no", "vector_text")).withColumn("bm25_text", F.col("vector_text"))
    else:
        vector = F.coalesce(F.nullif(strip(model(F.col("base"))), F.lit("")), F.col("base")) if mode == "hyde" else F.col("base")
        specs = rows.select("query_id", F.lit(0).alias("spec_no"), vector.alias("vector_text"), F.col("base").alias("bm25_text"))
    return specs.withColumn("bm25_text", keywords(F.col("bm25_text"))) if nlp else specs
