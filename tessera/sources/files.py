"""Sources: documents, chunks, query sets and logs, from files that Spark reads."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import split_list, stable_id, strip

DOCUMENT = "id string, title string, tags array<string>, content string, metadata map<string,string>"
CHUNK = "chunk_id string, source_id string, chunk_index int, title string, text string, tags array<string>, metadata map<string,string>"
#: What text files are called, which of them are left out, and the encodings tried in turn.
TEXT_SUFFIXES = r"(?i)\.(txt|md|markdown)$"
LEFT_OUT = r"(?i)(^|/)readme\.md$"
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """One document a line; blank lines are skipped and a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def decoded(raw: bytes | None) -> str | None:
    """Text in the first encoding that fits; else UTF-8 with replacement."""
    if raw is None:
        return None
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a text file, folders included; READMEs and files without text are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(TEXT_SUFFIXES) & ~F.col("path").rlike(LEFT_OUT))
    decode = F.pandas_udf(lambda s: pd.Series([decoded(b) for b in s]), "string")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = files.select("path", name.alias("title"), strip(decode("content")).alias("content")).where("content <> ''")
    meta = F.create_map(F.lit("source_type"), F.lit("file"), F.lit("path"), F.col("path"))
    return rows.select(stable_id(F.col("title")).alias("id"), "title", F.array(F.lit("doc")).alias("tags"), "content", meta.alias("metadata"))


#: The fields of a disease record and the heads of its paragraphs.
NAME, DEPARTMENTS, PREVALENCE = "疾病名称", "就诊科室", "患病概率"
TEXT_FIELDS, LIST_FIELDS = ("描述", "病因"), ("症状", "治疗方式", "检查项目")


def _text(field: str) -> Column:
    return F.coalesce(strip(F.col(f"`{field}`")), F.lit(""))


def _list(field: str) -> Column:
    return F.array_join(split_list(F.coalesce(F.col(f"`{field}`"), F.lit(""))), "、")


def disease_documents(records: DataFrame, position: str = "position") -> DataFrame:
    """Documents of disease records, one headed paragraph a field; records without a name are left out."""
    line = lambda head, text: F.when(text != "", F.concat(F.lit(head), text))
    header = F.concat_ws("\n", F.concat(F.lit(f"{NAME}："), _text(NAME)), line(f"{DEPARTMENTS}：", _list(DEPARTMENTS)), line(f"{PREVALENCE}：", _text(PREVALENCE)))
    paragraphs = [line(f"【{f}】\n", _text(f)) for f in TEXT_FIELDS] + [line(f"【{f}】\n", _list(f)) for f in LIST_FIELDS]
    meta = {"source_type": F.lit("disease"), "disease_name": _text(NAME), "department": _list(DEPARTMENTS), "category": _text("分类"), "symptoms": _list("症状"), "treatments": _list("治疗方式"), "exams": _list("检查项目"), "prevalence": _text(PREVALENCE)}
    tags = F.concat(F.array(F.lit("disease")), split_list(F.coalesce(F.col(f"`{DEPARTMENTS}`"), F.lit(""))))
    return records.where(_text(NAME) != "").select(
        F.format_string("disease_%05d", F.col(position)).alias("id"), _text(NAME).alias("title"), tags.alias("tags"), F.concat_ws("\n\n", header, *paragraphs).alias("content"),
        F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v))).alias("metadata"),
    )


def read_records(spark: SparkSession, path: str, max_records: int = 0) -> DataFrame:
    """The records of a JSON list with their position; ``max_records`` of 0 or less means all."""
    fields = ", ".join(f"`{f}` string" for f in (NAME, *TEXT_FIELDS, "分类", PREVALENCE, DEPARTMENTS, *LIST_FIELDS))
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("position", "r")).select("position", "r.*")
    return rows.where(F.col("position") < max_records) if max_records > 0 else rows


#: Formats of structured sources by name: a function of (spark, path, max_records).
STRUCTURED = {"diseases": lambda spark, path, max_records: disease_documents(read_records(spark, path, max_records))}


def corpus(*parts: tuple[str, DataFrame]) -> DataFrame:
    """The union of named sources, with the name in column ``source``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in parts])


def inspect(documents: DataFrame) -> DataFrame:
    """(source, n, n_chars) of a corpus, without an ingest."""
    return documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


def read_query_set(spark: SparkSession, text: str) -> DataFrame:
    """(query_id, question, expected, note) of a query set in YAML. It is a stated set, read on the driver."""
    loaded = yaml.safe_load(text) or []
    rows = [(str(q["id"]), str(q["question"]), [str(x) for x in q.get("expected_source_ids") or []], q.get("note") or q.get("interview_angle")) for q in (loaded["queries"] if isinstance(loaded, dict) else loaded)]
    return spark.createDataFrame(rows, "query_id string, question string, expected array<string>, note string")


def find_query(queries: DataFrame, query_id: str) -> DataFrame:
    found = queries.where(F.col("query_id") == query_id)
    if found.isEmpty():
        raise KeyError(f"no query {query_id}; there are {', '.join(r[0] for r in queries.select('query_id').orderBy('query_id').limit(200).collect())}")
    return found


def page_documents(pages: DataFrame, least_chars: int = 30) -> DataFrame:
    """Documents of parsed pages (file, page, modality, content): text pages of at least ``least_chars`` characters, tables
    and captions that aren't empty."""
    kept = F.when(F.col("modality") == "text", F.length(strip(F.col("content"))) >= least_chars).otherwise(F.coalesce(strip(F.col("content")), F.lit("")) != "")
    number = F.format_string("_p%04d", F.col("page"))
    return pages.where(kept).select(F.concat(F.lit("pdf_"), stable_id(F.col("file"), 60), number, F.when(F.col("modality") != "text", F.concat(F.lit("_"), "modality")).otherwise(F.lit(""))).alias("id"), F.col("file").alias("title"), "content", F.create_map(F.lit("page"), F.col("page").cast("string"), F.lit("modality"), F.col("modality")).alias("metadata"))


def figure_pages(pages: DataFrame, per_document: int, total: int) -> DataFrame:
    """The pages (file, page, n_images) to caption: of each file those with most images, up to ``per_document``, and
    ``total`` in all, in the order of files."""
    ranked = pages.where("n_images > 0").withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy(F.col("n_images").desc(), "page"))).where(F.col("nth") <= per_document)
    return ranked.orderBy("file", "nth").limit(total)


def figures(chunks: DataFrame) -> DataFrame:
    """(image_path, source_id, caption): each image of chunks with metadata modality 'figure' once, with its first caption."""
    rows = chunks.where(F.col("metadata")["modality"] == "figure").select(F.col("metadata")["image_path"].alias("image_path"), "source_id", "chunk_index", F.col("text").alias("caption"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("image_path").orderBy("source_id", "chunk_index"))).where("n = 1").select("image_path", "source_id", "caption")


def table_markdown(grid: Column, min_rows: int = 2) -> Column:
    """A grid (array of rows of cells) as a pipe table; null for tables too small or too empty to be one."""
    cells = F.transform(grid, lambda r: F.transform(r, lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))))
    rows = F.filter(cells, lambda r: F.size(r) > 0)
    width = F.size(rows[0])
    full = F.size(F.filter(F.flatten(rows), lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |\n"))
    fitted = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    body = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(fitted(r))), "")
    return F.when((F.size(rows) >= min_rows) & (full >= 4) & (width >= 2), F.concat(line(rows[0]), line(F.array_repeat(F.lit("---"), width)), body))


def latest_runs(log: DataFrame) -> DataFrame:
    """The last run (by seq) of each label and query set."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy("label", "eval_set").orderBy(F.col("seq").desc()))).where("__n = 1").drop("__n")
