"""Words of texts that are written without spaces, by a dictionary of corpus frequencies.

The words of the dictionary that a text has at each place form a graph, found by walking a trie; the best path through it has
the greatest product of relative frequencies, found by dynamic programming from the end. A character that no word covers stands
for itself, as if it had come once; runs of Latin letters and digits that no word cuts are one word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rewriting import PUNCTUATION, STOP_WORDS

#: The words of a dictionary at most: the most frequent ones. It is sent to every task.
MOST_WORDS = 200_000
_RUN = re.compile(r"[a-zA-Z0-9]+")


def corpus_words(texts: DataFrame, text_col: str = "text", pattern: str = r"[\p{L}\p{N}]+", least: int = 1) -> DataFrame:
    """(word, n): how often each word of the texts comes, in lower case."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Segmenter:
    """The dictionary as a trie of nested tables, with logarithms of frequencies."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        words = [(w, n) for w, n in words if w and n > 0]
        self.total = math.log(max(1, sum(n for _, n in words)))
        self.trie: dict = {}
        for word, n in words:
            at = self.trie
            for c in word:
                at = at.setdefault(c, {})
            at[""] = math.log(n) - self.total

    def edges(self, text: str, i: int) -> list[tuple[int, float]]:
        """(end, weight) of the words at place i; of a character alone, or the run of letters and digits there, if there is none."""
        found, at, k = [], self.trie, i
        while k < len(text) and (at := at.get(text[k])) is not None:
            k += 1
            if "" in at:
                found.append((k, at[""]))
        if not found or found[0][0] > i + 1:
            found.append((i + 1, -self.total))
        return found

    def cut(self, text: str) -> list[str]:
        """The words of the best path; of equally good ones that with the longer first word. Case is left as it is, words are
        looked up in lower case."""
        low = text.lower()
        low = low if len(low) == len(text) else text
        best: list[tuple[float, int]] = [(0.0, len(low))] * (len(low) + 1)
        for i in range(len(low) - 1, -1, -1):
            best[i] = max((w + best[end][0], end) for end, w in self.edges(low, i))
        out, i, known = [], 0, []
        while i < len(low):
            end = best[i][1]
            out.append(text[i:end])
            known.append(end - i > 1 or "" in self.trie.get(low[i], {}))
            i = end
        # letters and digits next to each other that no word covers are one word
        joined: list[str] = []
        loose = False
        for word, sure in zip(out, known, strict=True):
            run = not sure and _RUN.fullmatch(word) is not None
            if run and loose:
                joined[-1] += word
            else:
                joined.append(word)
            loose = run
        return joined


def segmented(texts: DataFrame, words: DataFrame, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """(id, words): the words of each text by the dictionary words (word, n), white space left out. The dictionary is the MOST_WORDS most
    frequent words, equally frequent ones in their order, so that what every task gets has a bound. Null texts have no words."""
    known = [(r["word"], r["n"]) for r in words.orderBy(F.col("n").desc(), "word").limit(MOST_WORDS).collect()]
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        segmenter = Segmenter(known)
        for batch in batches:
            cut = [[w.strip() for w in segmenter.cut(t) if w.strip()] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cut, pa.list_(pa.string()))], ["id", "words"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, words array<string>")


def without_stop_words(words: Column, text: Column, stop_words: Iterable[str] = tuple(STOP_WORDS)) -> Column:
    """Words joined by spaces, without stop words and punctuation; the text itself where nothing is left."""
    kept = F.filter(words, lambda w: ~w.isin(*stop_words) & ~w.rlike(f"^(?:{PUNCTUATION})$"))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)
