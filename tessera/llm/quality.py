"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample, and a document is tried against the rules in the order of
rejections per cost until one rejects it. The order decides how much work is done and never the verdict. Features that
several rules share are made once a document.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, map_arrow

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = frozenset([*range(65, 91), *range(97, 123), *range(128, 256)])
#: For counting words that hold a letter: letters and white space stay, anything else goes.
_NO_LETTER = bytes(c for c in range(256) if c not in _LETTERS and c not in _SPACE)
#: Frequent function words of the corpus's four languages.
STOP_WORDS = frozenset(
    b"the of and to in is that it for was with as on be at by this are or an not which you have from "
    b"le la les de des et un une en que qui dans pour pas sur est au par du ce il elle avec "
    b"der die und das ist nicht mit den von zu ein eine auf im dem sich es auch als "
    b"el los las y se del con una su para lo como al o".split()
)
_PUNCTUATION = b".,;:!?\"'()[]"


class Features:
    """The features of one text, each computed when first asked for. Words are separated by ASCII white space."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw) + len(self.raw.translate(None, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen, again = set(), set()
        for x in windows:
            (again if x in seen else seen).add(x)
        n, covered = 0, 0  # covered: words before this position are counted already
        for i, x in enumerate(windows):
            if x in again:
                n += i + 3 - max(i, covered)
                covered = i + 3
        return n

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def n_letter_words(self) -> int:
        return len(self.raw.translate(None, _NO_LETTER).split())

    @cached_property
    def n_stop_words(self) -> int:
        return sum(map(STOP_WORDS.__contains__, self.raw.lower().translate(None, _PUNCTUATION).split()))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: The thresholds are parameters of the rules; the first two are the base.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 40 * len(f.lines)),
    Rule("word_length", lambda f: not 3 * f.n_words <= f.word_chars <= 10 * f.n_words),
    Rule("upper_case", lambda f: 10 * f.n_upper > 3 * f.word_chars),
    Rule("no_letters", lambda f: 10 * f.n_letter_words < 8 * f.n_words),
    Rule("stop_words", lambda f: 50 * f.n_stop_words < f.n_words),
)
BASE = ("few_words", "repeated_words")
#: Texts of each task's input on which costs and rejections are estimated, at most, and the share of texts that are taken for it.
SAMPLE_A_TASK, SAMPLE_SHARE = 8, 8


def measure(text: str | None, rules: tuple[Rule, ...] = RULES) -> tuple[int, int, float, list[float]]:
    """(rejecting rules, rules that need the words, seconds to split the words, seconds of each rule beside that) of a text; the
    rules as bits of a number."""
    began = time.perf_counter()
    words = Features(text).words
    shared = time.perf_counter() - began
    rejecting = needing = 0
    costs = []
    for k, rule in enumerate(rules):
        fresh = Features(text)
        rejecting |= rule.rejects(fresh) << k
        needing |= ("words" in vars(fresh)) << k
        f = Features(text)
        f.words = words
        began = time.perf_counter()
        rule.rejects(f)
        costs.append(time.perf_counter() - began)
    return rejecting, needing, shared, costs


def cascade(seen: list[tuple[int, int, int, float, list[float]]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules in the order of rejections per second. seen: (rejecting, needing, texts, seconds for words, seconds of each rule) of
    texts with the same rejecting rules. A rule counts for the texts that those before it let pass, and the words for the first
    rule that needs them; ties keep the order given."""
    left, order, split = list(seen), [], False
    while len(order) < len(rules):
        texts = max(1, sum(n for _, _, n, _, _ in left))
        scores = []
        for k in (k for k in range(len(rules)) if k not in order):
            rejected = sum(n for r, _, n, _, _ in left if r >> k & 1)
            cost = sum(c[k] + (w if need >> k & 1 and not split else 0.0) for _, need, _, w, c in left)
            scores.append((-(rejected / texts) / max(cost / texts, 1e-9), k))
        k = min(scores)[1]
        split = split or any(need >> k & 1 for _, need, _, _, _ in left)
        left = [x for x in left if not x[0] >> k & 1]
        order.append(k)
    return tuple(rules[k] for k in order)


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[Rule, ...]:
    """The rules in the order that a sample calls for: the first few texts of every task's input, by hash. Texts are measured where
    they lie; what comes to the driver is a row for each set of rules that reject some text together."""
    costs = [f"c{k}" for k in range(len(rules))]
    names = ["rejecting", "needing", "n", "words", *costs]

    def sampled(batches):
        rows = []
        for batch in batches:
            for t in batch.column("text").to_pylist():
                rows.append(measure(t, rules))
                if len(rows) == SAMPLE_A_TASK:
                    break
            if len(rows) == SAMPLE_A_TASK:
                break
        if rows:
            rejecting, needing, words, each = zip(*rows, strict=True)
            columns = [pa.array(rejecting, pa.int64()), pa.array(needing, pa.int64()), pa.array([1] * len(rows), pa.int64()), pa.array(words), *(pa.array(c) for c in zip(*each, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names)

    bound_batches(docs.sparkSession)
    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0)
    found = some.mapInArrow(sampled, "rejecting long, needing long, n long, words double, " + ", ".join(f"{c} double" for c in costs))
    sums = found.groupBy("rejecting").agg(F.expr("bit_or(needing)").alias("needing"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ("words", *costs))).collect()
    return cascade([(r["rejecting"], r["needing"], r["n"], r["words"], [r[c] for c in costs]) for r in sums], rules)


def first_rejection(f: Features, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(f)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, with_counts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, rejected_by[, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed]) per row.

    A null text has no words and is rejected, as an empty one is. Repeated rows and null ids are judged as they come;
    very long texts are judged whole. Other columns are ignored. An empty table gives an empty result. ``rejected_by``
    is the rule that happened to come first; ``kept`` doesn't depend on the order. ``with_counts`` computes the counts
    for every row, also for rows that an early rule rejects.
    """
    order = ordered_rules(docs, rules, text_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if with_counts else []
    base = tuple(r for r in rules if r.name in BASE)
    names = ["doc_id", "kept", "rejected_by", *counts, *(["base_failed"] if with_counts else [])]

    def verdicts(batch: pa.RecordBatch) -> pa.RecordBatch:
        rejected, numbers, failed = [], [[] for _ in counts], []
        for t in batch.column("text").to_pylist():
            f = Features(t)
            rejected.append(first_rejection(f, order))
            for column, c in zip(numbers, counts, strict=True):
                column.append(getattr(f, c))
            if with_counts:
                failed.append(first_rejection(f, base) is not None)
        columns = [batch.column("doc_id"), pa.array([r is None for r in rejected]), pa.array(rejected, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(failed, pa.bool_())] if with_counts else []), names)

    schema = "doc_id long, kept boolean, rejected_by string" + "".join(f", {c} long" for c in counts) + (", base_failed boolean" if with_counts else "")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), verdicts, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; rules are tried in the sampled order.

    Rows with a null or empty text go, as they have no words; repeated rows stay or go together; null ids don't matter. An empty
    table stays empty.
    """
    order = ordered_rules(docs, rules, text_col)

    def passing(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return batch.filter(pa.array([first_rejection(Features(t), order) is None for t in texts], pa.bool_()))

    return map_arrow(docs, passing, docs.schema)
