"""Benchmark decontamination by the q-gram lemma.

An occurrence of a benchmark item with at most k edits keeps m - q + 1 - kq of its m - q + 1 character q-grams, on
diagonals (document position minus item position) that differ by k at most. Shared q-grams are therefore counted in
overlapping diagonal bands, bands that reach the count are kept, and a banded alignment verifies them.

The lemma holds for any choice of an item's q-grams: edits destroy kq of them at most, so c chosen ones leave c - kq. Frequent
q-grams are therefore left out as far as enough rarer ones remain. An item that repeats itself, so that this doesn't suffice, is
looked for by the places of its q-grams alone: all that survive lie within one stretch of the item's length and budget.

Texts are compared in lower case with white space collapsed. The benchmark is the stated query set: it is read in blocks
of bounded size, and every block is held against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

#: Characters of a q-gram; eight fit one 64-bit word.
Q = 8
#: Edits allowed for each character of an item.
EDIT_RATE = 0.1
#: Characters of benchmark text that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000
#: Characters of document text looked at in one step.
CHARS_AT_ONCE = 2_000_000
#: Occurrences in a block of items up to which a q-gram is rare, and how many occurrences are looked at in one step.
RARE = 32
HITS_AT_ONCE = 4_000_000
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edit_budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item, such that the lemma still asks for a shared q-gram."""
    return max(0, min(int(length * rate), (length - Q) // Q))


def _codes(text: str) -> tuple[bytes, np.ndarray | None]:
    """The low byte of each character, and what lies above it, or None if nothing does."""
    try:
        return text.encode("latin-1"), None
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return codes.astype(np.uint8).tobytes(), codes >> np.uint32(8)


def _grams(raw: bytes) -> np.ndarray:
    """The low bytes of the q-gram at each position, as a number."""
    n = len(raw) - Q + 1
    out = np.empty(max(0, n), np.uint64)
    for s in range(min(Q, max(0, n))):
        part = np.frombuffer(raw, "<u8", (len(raw) - s) // 8, s)
        out[s::8] = part[: len(out[s::8])]
    return out


def _widened(grams: np.ndarray, high: np.ndarray | None) -> np.ndarray:
    """The q-grams of one text with the upper parts of its characters mixed in; those without such characters stay."""
    if high is None or not len(grams):
        return grams
    mixed = np.zeros(len(grams), np.uint64)
    for k in range(Q):
        mixed += high[k : k + len(grams)].astype(np.uint64) * (_MIX ** np.uint64(k + 1) | np.uint64(1))
    return grams ^ (mixed * _MIX)


def banded_distance(item: str, window: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """(edits, end in window) of the best occurrence of item within the window with at most budget edits, or None.

    The alignment starts (``anchored``: at the window's beginning, else anywhere) and ends anywhere in the window; of equal
    ends of an anchored one the nearest to the item's length. Cells are kept for the diagonals of the window only.
    """
    m, n = len(item), len(window)
    band = n - m + 2 * budget + 1  # diagonals -budget .. n - m + budget
    if band <= 0:
        return None
    a = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4")
    b = np.full(n + 2 * budget + m + 1, 0xFFFFFFFF, np.uint32)  # b[j + budget] is the window's character j
    b[budget : budget + n] = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), "<u4")
    far, steps = np.int32(m + n + 1), np.arange(band, dtype=np.int32)
    # row[d] is the least cost of aligning the item's first i characters to end before window character i + d - budget
    row = np.where((steps - budget >= 0) & (steps - budget <= n), steps - budget if anchored else 0, far).astype(np.int32)
    for i in range(1, m + 1):
        replaced = row + (b[i - 1 : i - 1 + band] != a[i - 1])
        deleted = np.append(row[1:], far) + 1
        best = np.minimum(replaced, deleted)
        at = steps + i - budget
        best[(at < 0) | (at > n)] = far
        row = (np.minimum.accumulate(best - steps) + steps).astype(np.int32)
        row[(at < 0) | (at > n)] = far
        if row.min() > budget:
            return None
    best = np.flatnonzero(row == row.min())
    k = int(best[np.abs(best - budget).argmin()] if anchored else best[0])
    return (int(row[k]), k + m - budget) if row[k] <= budget else None


def true_start(item: str, text: str, end: int, edits: int) -> int:
    """Where an occurrence of item that ends at ``end`` with so many edits begins; of several places, where it is as long as
    the item, or nearly so."""
    low = max(0, end - len(item) - edits)
    a, b = item[::-1], text[low:end][::-1]
    found = banded_distance(a, b, edits, anchored=True)
    return end - found[1] if found else max(0, end - len(item))


class BenchmarkIndex:
    """The q-grams of a block of items, and the search for occurrences in documents. Equal items are looked for once."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], rate: float = EDIT_RATE):
        owners = defaultdict(list)
        for i, t in items:
            owners[normalised(t)].append(i)
        owners.pop("", None)
        self.short = [(ids, t) for t, ids in owners.items() if len(t) < Q]
        kept = [(ids, t) for t, ids in owners.items() if len(t) >= Q]
        self.ids, self.texts = [ids for ids, _ in kept], [t for _, t in kept]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.budgets = np.array([edit_budget(len(t), rate) for t in self.texts], np.int64)
        self.half = self.budgets + 1  # a band is two halves wide and overlaps the next by one
        coded = [_codes(t) for t in self.texts]
        grams = [_widened(_grams(raw), high) for raw, high in coded]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        _, code, times = np.unique(every, return_inverse=True, return_counts=True)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        chosen, self.needed, repetitive = self._choice(grams, times[code] if len(every) else times)
        self.repetitive = np.flatnonzero(repetitive)
        order = np.flatnonzero(chosen)
        order = order[np.argsort(every[order], kind="stable")]
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.offset = item[order], offset[order]
        self.may = np.zeros(1 << _BITS, bool)
        for g in [self.grams, *(grams[i] for i in self.repetitive)]:
            self.may[(g * _MIX) >> np.uint64(64 - _BITS)] = True
        self.own = {int(i): np.unique(grams[i]) for i in self.repetitive}
        self.gap = int((self.lengths + 4 * self.half).max()) + Q if kept else Q

    def _choice(self, grams: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which q-grams of all items are looked up, how many of an item's a band must have, and which items repeat themselves."""
        chosen, needed, repetitive, at = np.zeros(len(times), bool), [], [], 0
        for g, budget in zip(grams, self.budgets.tolist(), strict=True):
            mine = times[at : at + len(g)]
            least = budget * Q + 1
            take = np.sort(mine)[min(len(g), max(least + least // 8, int((mine <= RARE).sum()))) - 1]
            use = mine <= max(RARE, take)
            repetitive.append(bool(np.bincount(np.unique(g[use], return_inverse=True)[1]).max(initial=0) > RARE))
            if not repetitive[-1]:
                chosen[at : at + len(g)] = use
            needed.append(int(use.sum()) - budget * Q)
            at += len(g)
        return chosen, np.array(needed, np.int64), np.array(repetitive, bool)

    def _bands(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to): diagonals, relative to the text, between which an item may occur."""
        coded = [_codes(t) for t in texts]
        raw = b"".join(low for low, _ in coded) + bytes(Q)
        starts = np.concatenate([[0], np.cumsum([len(low) for low, _ in coded])])
        grams = _grams(raw)
        for k, (_, high) in enumerate(coded):
            if high is not None and (n := len(high) - Q + 1) > 0:
                grams[starts[k] : starts[k] + n] = _widened(grams[starts[k] : starts[k] + n], high)
        at = np.flatnonzero(self.may[(grams * _MIX) >> np.uint64(64 - _BITS)])
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + Q <= starts[text + 1]
        at, text = at[inside], text[inside]
        yield from self._stretches(grams, at, text, starts)
        found = np.searchsorted(self.grams, grams[at])
        found[found == len(self.grams)] = 0
        same = self.grams[found] == grams[at] if len(self.grams) else np.zeros(len(at), bool)
        at, found, text = at[same], found[same], text[same]
        times = self.first[found + 1] - self.first[found]
        most = int((starts[-1] + (len(texts) + 2) * self.gap) + 2)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.cumsum(times)
        cuts = [0, *np.searchsorted(total, np.arange(HITS_AT_ONCE, int(total[-1]) if len(total) else 0, HITS_AT_ONCE)).tolist(), len(at)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                key, count = self._counted(at[low:high], found[low:high], text[low:high], times[low:high], most)
                if len(keys):
                    key, where = np.unique(np.concatenate([keys, key]), return_inverse=True)
                    count = np.bincount(where, np.concatenate([counts, count])).astype(np.int64)
                keys, counts = key, count
        item, band = keys // most, keys % most
        enough = counts >= self.needed[item]
        spread = starts[:-1] + np.arange(len(texts)) * self.gap + self.gap  # diagonal 0 of each text
        for i, b in zip(item[enough].tolist(), band[enough].tolist(), strict=True):
            low = b * int(self.half[i])
            high = low + 2 * int(self.half[i]) - 1
            k = int(np.searchsorted(spread - self.gap // 2, high, side="right")) - 1
            yield k, i, low - int(spread[k]), high - int(spread[k])

    def _counted(self, at: np.ndarray, found: np.ndarray, text: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(item and band as one number, q-grams in it) of the q-grams ``found`` at the places ``at``."""
        ends = np.cumsum(times)
        which = np.repeat(self.first[found] - (ends - times), times) + np.arange(ends[-1])
        item = self.item[which]
        # texts lie a gap apart, so that no band holds diagonals of two
        diagonal = np.repeat(at + text * self.gap, times) - self.offset[which] + self.gap
        band = diagonal // self.half[item]
        return np.unique(np.concatenate([item * most + band, item * most + np.maximum(band - 1, 0)]), return_counts=True)

    def _stretches(self, grams: np.ndarray, at: np.ndarray, text: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """As _bands(), for items that repeat themselves: stretches of text with enough of an item's q-grams, whatever their offsets."""
        for i in self.repetitive.tolist():
            places = at[np.isin(grams[at], self.own[i])]
            owner = np.searchsorted(starts, places, side="right") - 1
            need, reach = int(self.needed[i]), int(self.lengths[i] + self.budgets[i])
            if len(places) < need:
                continue
            first, last = places[: len(places) - need + 1], places[need - 1 :]
            good = np.flatnonzero((last - first < reach) & (owner[: len(first)] == owner[need - 1 :]))
            following = (0, 0)  # stretches overlap by an item's reach, so that none is cut
            for k, p in zip(owner[good].tolist(), (places[good] - starts[owner[good]]).tolist(), strict=True):
                if (k, p) >= following:
                    yield k, i, p - reach, p + reach
                    following = (k, p + reach // 2)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(text, item_id, start, end, edits) of every occurrence; of overlapping ones of an item, the closest. Positions
        are those of the texts as given."""
        given, texts = texts, [normalised(t) for t in texts]
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        if self.texts:
            for k, i, low, high in self._bands(texts):
                item, budget = self.texts[i], int(self.budgets[i])
                a, b = max(0, low - budget), min(len(texts[k]), high + len(item) + budget)
                window = texts[k][a:b]
                p = window.find(item)
                hit = (0, p + len(item)) if p >= 0 else banded_distance(item, window, budget)
                if hit:
                    edits, end = hit[0], a + hit[1]
                    start = end - len(item) if not edits else true_start(item, texts[k], end, edits)
                    best.setdefault((k, i), []).append((edits, start, end))
        # short items, and those that repeat themselves and so may follow each other closely, are looked for verbatim
        verbatim = [(-1 - j, t) for j, (_, t) in enumerate(self.short)] + [(i, self.texts[i]) for i in self.repetitive.tolist()]
        for k, t in enumerate(texts):
            for i, item in verbatim:
                p = t.find(item)
                while p >= 0:
                    best.setdefault((k, i), []).append((0, p, p + len(item)))
                    p = t.find(item, p + len(item))
        at_text = -1
        for (k, i), hits in sorted(best.items()):
            if k != at_text:
                at_text, place = k, original_places(given[k] or "", texts[k])
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(set(hits)):
                if all(end <= x or start >= y for x, y in taken):
                    taken.append((start, end))
                    for owner in self.ids[i] if i >= 0 else self.short[-1 - i][0]:
                        yield k, owner, place(start), place(end - 1) + 1 if end > start else place(start), edits


def original_places(text: str, normal: str):
    """A function from a position in the normalised text to the position of that character in the text."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    if len(text.lower()) == len(text) and sum(b - a for a, b in words) + len(words) - 1 == len(normal):
        begins = np.cumsum([0, *(b - a + 1 for a, b in words)])[:-1] if words else np.zeros(1, np.int64)

        def place(at: int) -> int:
            w = int(np.searchsorted(begins, at, side="right")) - 1
            return words[w][0] + at - int(begins[w])

        return place
    places: list[int] = []  # characters that get longer in lower case, one at a time
    for i, c in enumerate(text):
        if not c.isspace():
            places += [i] * len(c.lower())
        elif places and i + 1 < len(text) and not text[i + 1].isspace():
            places.append(i)
    return lambda at: places[min(at, len(places) - 1)] if places else 0


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int | None, str], ...], rate: float) -> BenchmarkIndex:
    return BenchmarkIndex(items, rate)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    first, held, chars = 0, [], 0
    for t in texts:
        held.append(t)
        chars += len(t or "")
        if chars >= CHARS_AT_ONCE:
            yield first, held
            first, held, chars = first + len(held), [], 0
    if held:
        yield first, held


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items in blocks of at most BLOCK_CHARS characters (one longer item is a block)."""
    held, chars = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        if held and chars + len(row[1]) > BLOCK_CHARS:
            yield tuple(held)
            held, chars = [], 0
        held.append((row[0], row[1]))
        chars += len(row[1])
    if held:
        yield tuple(held)


HITS = "doc_id long, item_id long, start long, end long, edits long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): where a document holds a benchmark item, with at most ``rate`` edits a
    character. Positions are those of the document's text as it is, ends exclusive.

    Null and empty texts hold nothing, null and empty items are in nothing. Items shorter than a q-gram are looked for
    verbatim. Repeated rows and items are reported as often as they come; null ids are kept. Other columns are ignored.
    Either table being empty gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for items in blocks(benchmark):

        def search(batch: pa.RecordBatch, items=items):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[first + k], *hit) for first, some in _slices(batch.column("text").to_pylist()) for k, *hit in _index(items, rate).search(some)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["doc_id", "item_id", "start", "end", "edits"])

        one = map_arrow(source, search, HITS)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], HITS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no benchmark item. No row is moved between tasks.

    Rows with a null or empty text stay, and repeated rows stay or go together; null and empty items are in nothing. An
    empty table of either kind leaves docs as it is.
    """
    for items in blocks(benchmark):

        def clean(batch: pa.RecordBatch, items=items) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            keep = np.ones(len(texts), bool)
            for first, some in _slices(texts):
                for k, *_ in _index(items, rate).search(some):
                    keep[first + k] = False
            return batch.filter(pa.array(keep))

        docs = map_arrow(docs, clean, docs.schema)
    return docs
