"""Text functions as column expressions; every one is a JVM expression, null in gives null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns whose matches must agree with the search results of earlier indexes.
TOKEN = r"[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_./:+-]+"
KEY_NOISE = "[\\s\\u00a0\\u3000\\-_:：,.()（）]+"
LIST_SEPARATORS = "[,，、;；]+"
VALUE_UNIT = r"^([<>]?\d+(?:\.\d+)?)\s*([^\d\s].*)$"


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", "")


def clean_text(text: Column) -> Column:
    """Unix line ends, single spaces, at most one blank line in a row, stripped."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, "[ \t]+", " "), "\n{3,}", "\n\n"))


def tokenize(text: Column) -> Column:
    """Lower-case tokens: each ideograph, and each run of letters, digits and ``_./:+-``."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stable_id(text: Column, longest: int = 120) -> Column:
    """An identifier of lower-case letters, digits, ideographs and underscores."""
    slug = F.regexp_replace(F.replace(F.lower(text), F.lit("\\"), F.lit("/")), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "_")
    return F.left(F.coalesce(F.nullif(F.regexp_replace(slug, "^_+|_+$", ""), F.lit("")), F.lit("doc")), F.lit(longest))


def split_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a list written with Latin or Chinese separators."""
    return F.filter(F.transform(F.split(text, LIST_SEPARATORS), strip), lambda x: x != "")


def norm_key(name: Column) -> Column:
    """What two spellings of an entity have in common: lower case, no spaces, hyphens, colons, brackets."""
    return F.regexp_replace(F.lower(strip(name)), KEY_NOISE, "")


def paper_of(source_id: Column) -> Column:
    return F.regexp_replace(F.coalesce(source_id, F.lit("")), r"_p\d+[\s\S]*$", "")


def value_and_unit(value: Column, unit: Column) -> Column:
    """Struct (value, unit): a unit written behind a number is split off where unit is empty."""
    split = (F.coalesce(unit, F.lit("")) == "") & value.rlike(VALUE_UNIT)
    return F.struct(
        F.when(split, F.regexp_extract(value, VALUE_UNIT, 1)).otherwise(value).alias("value"),
        F.when(split, F.regexp_extract(value, VALUE_UNIT, 2)).otherwise(unit).alias("unit"),
    )


def without_unit(ref_range: Column, unit: Column) -> Column:
    """A reference range without the unit behind it."""
    tail = (F.coalesce(unit, F.lit("")) != "") & ref_range.endswith(unit)
    return F.when(tail, F.rtrim(F.left(ref_range, F.length(ref_range) - F.length(unit)))).otherwise(ref_range)


def characters(text: Column) -> Column:
    """The characters of a text, in one pass over it."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def bigrams(text: Column) -> Column:
    """The set of character pairs; one character is its own set, nothing an empty one."""

    def pairs(c: Column) -> Column:
        return F.when(F.size(c) >= 2, F.array_distinct(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y)))).otherwise(c)

    return let(characters(text), pairs)


def question_bigrams(text: Column) -> Column:
    """bigrams() of the letters, digits, underscores and ideographs of a question."""
    return bigrams(F.regexp_replace(text, r"(?U)[^\w\x{4e00}-\x{9fff}]+", ""))


def overlap(a: Column, b: Column) -> Column:
    """Elements in common as a share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def json_array(text: Column, element: str) -> Column:
    """The JSON array between the first [ and the last ]; empty if there is none or it is broken."""
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(inner, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def json_object(text: Column, schema: str) -> Column:
    """The JSON object between the first { and the last }; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def strip_think(text: Column) -> Column:
    """Without <think> blocks; one that isn't closed goes to the end, as documented."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def snippet(text: Column, limit: int = 160) -> Column:
    """White space collapsed; longer texts end in three dots within the limit."""
    flat = strip(F.regexp_replace(text, "[\\s\\u00a0\\u3000]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("..."))).otherwise(flat)


def cache_key(doc_id: Column, text: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit(":"), F.left(F.md5(text), F.lit(12)))


def verbalize(name: Column, fields: list[tuple[str, Column]]) -> Column:
    """A record as headed paragraphs; empty fields are left out, and a record without a name is null."""
    full = [F.when(F.coalesce(strip(value), F.lit("")) != "", F.concat(F.lit(f"{head}: "), strip(value))) for head, value in fields]
    return F.when(F.coalesce(strip(name), F.lit("")) != "", F.concat_ws("\n\n", strip(name), *full))


#: The heads of briefs, and what a record's description stands behind.
TITLE_HEAD, SUMMARY_HEAD, NAME_HEAD, EXCERPT_HEAD, DESCRIPTION = "标题：", "摘要：", "疾病名称：", "描述节选：", "【描述】"
RECORD_HEADS = {"department": "就诊科室：", "symptoms": "症状：", "exams": "检查项目：", "treatments": "治疗方式："}


def document_brief(title: Column, content: Column, limit: int = 300) -> Column:
    """Title and the beginning of the content, for a prompt; nulls are empty."""
    return F.concat(F.lit(TITLE_HEAD), F.coalesce(title, F.lit("")), F.lit(f"\n{SUMMARY_HEAD}"), F.left(F.coalesce(content, F.lit("")), F.lit(limit)))


def record_brief(name: Column, fields: dict[str, Column], content: Column, with_name: bool = True, excerpt: int = 196) -> Column:
    """A record for a prompt, one headed line a field (by the names of RECORD_HEADS): empty ones are left out. Of the content comes the beginning of its
    description, on one line, where it has one."""
    lines = [F.concat(F.lit(NAME_HEAD), F.coalesce(name, F.lit("")))] if with_name else []
    lines += [F.when(F.coalesce(fields[k], F.lit("")) != "", F.concat(F.lit(head), fields[k])) for k, head in RECORD_HEADS.items() if k in fields]
    at = F.instr(F.coalesce(content, F.lit("")), DESCRIPTION)
    begun = F.replace(strip(F.substring(content, at + len(DESCRIPTION), F.lit(excerpt))), F.lit("\n"), F.lit(" "))
    return F.concat_ws("\n", *lines, F.when(at > 0, F.concat(F.lit(EXCERPT_HEAD), begun)))


def replace_all(text: Column, words: list[str], by: str = " ") -> Column:
    return reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(by)), words, text)


def let(value: Column, then) -> Column:
    """then(value), with value computed once within a lambda."""
    return F.transform(F.array(value), then)[0]


def join_overlap(parts: Column, least: int = 10, most: int = 200) -> Column:
    """Texts joined in order; where a text begins with the end of what came before (over ``least`` characters, up to
    ``most``), that part is written once, and otherwise a line end stands between."""

    def add(seen, part):
        tail = seen["tail"]
        longest = F.least(F.length(tail), F.length(part), F.lit(most))
        fits = F.filter(F.sequence(longest, F.lit(least + 1), F.lit(-1)), lambda k: F.right(tail, k) == F.left(part, k))
        shared = F.when(longest > least, F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0))).otherwise(F.lit(0))
        behind = let(shared, lambda k: F.when((k > 0) | (tail == ""), F.substring(part, k + 1, F.length(part))).otherwise(F.concat(F.lit("\n"), part)))
        return let(behind, lambda new: F.struct(F.right(F.concat(tail, new), F.lit(most)).alias("tail"), F.concat(seen["pieces"], F.array(new)).alias("pieces")))

    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<string>").alias("pieces"))
    return F.aggregate(parts, start, add, lambda seen: F.array_join(seen["pieces"], ""))
