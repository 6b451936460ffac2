"""Repeated passages by MinHash banding.

A paragraph is any passage of PASSAGE words, wherever it begins. A band's key is made of the MinHashes of its five-word
shingles, one a row; neighbouring paragraphs share theirs, so each key is emitted once for a run of them, at the shingle
(the anchor) that gives the first row. The number of bands is tuned for recall at the similarity asked for; exact repeats
collide in every band.

Colliding paragraphs are joined with the first document that has the key and, within the key, with the first that agrees with
them in further MinHashes too (the rows of another band): a third document that shares a phrase only rarely does. They are verified
by the Jaccard similarity of their windows around the anchor, repeated shingles counted. The windows that this document doesn't stand for are joined with each
other by two digests of all their shingles: so an exact repeat is never lost to a third document that shares a phrase with
it. Those of one key are then held against each other, and against the near copies of its first document, by bitmaps of their shingles; what these
don't exclude is verified too, so that every pair of paragraphs that collides is verified, or stands in one cluster by what equals it.
Overlapping spans are clustered by connected components; words stay unless a smaller document has their copy.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_dealt, map_arrow
from tessera.operators.components import connected_components
from tessera.storage import Workspace

SHINGLE = 5
#: Words of a passage: repeats of over 50 words are found.
PASSAGE = 51
SIMILARITY = 0.8
#: Least share of passages at SIMILARITY that must collide in some band.
RECALL = 0.95
#: Rows of a band.
ROWS = 2
#: Positions of a document that one comparison with another document spans, about.
STRETCH = 4096
#: Places of diagonals that are compared at once.
PLACES_AT_ONCE = 600_000
#: Windows whose shingles are put in order at once.
WINDOWS_AT_ONCE = 1 << 15
#: Bytes of text that are hashed at once.
BYTES_AT_ONCE = 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(rows: int = ROWS, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Bands that a pair of this similarity needs to collide in one of them with this probability."""
    alike = similarity**rows
    return 1 if alike >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - alike) - 1e-9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, where each text's words start, and the end). Words are separated by ASCII white
    space and compared without regard to the case of A-Z; a null text has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    coded = words.dictionary_encode()
    distinct = np.array([xxhash.xxh32_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.uint32)
    offsets = split.offsets.to_numpy()
    starts = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    return (distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint32))[real], starts


def shingles_of(words: np.ndarray) -> np.ndarray:
    """A hash of every run of SHINGLE words."""
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = _mixed(h ^ words[k : k + n].astype(np.uint64) + np.uint64(k))
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of ``width``."""
    k = 1
    while 2 * k <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (width - k)], v[width - k :]) if width > k else v


def band_keys(shingles: np.ndarray, width: int, rows: int, band: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each window of ``width`` shingles: the key of its MinHashes in a band, the place of the first row's, and 32 bits of each row's."""
    n = len(shingles) - width + 1
    bits = np.uint64((1 << (width - 1).bit_length()) - 1)
    place = np.arange(len(shingles), dtype=np.uint64) & bits
    key, first, marks = np.full(n, band + 1, np.uint64), None, []
    for row in range(rows):
        salt = _mixed(np.array([(rows << 16) + (band << 8) + row], np.uint64))
        least = _least((_mixed(shingles ^ salt) & ~bits) | place, width)
        if first is None:
            s = np.arange(n, dtype=np.uint64)
            first = (s + ((least - s) & bits)).astype(np.int64)
        key = _mixed(key ^ (least & ~bits))
        marks.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return key, first, marks


def digests(windows: np.ndarray, kind: int) -> np.ndarray:
    """A digest of every row of shingles, in order; kinds are independent of each other."""
    powers = _mixed(np.arange(1, windows.shape[1] + 1, dtype=np.uint64) + np.uint64(kind << 32)) | np.uint64(1)
    return _mixed((windows * powers).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _changes(key: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Of the windows ``at``, those that don't go on with the key of the window before; in a text that repeats itself, where
    the key doesn't change, one for each ``width``."""
    if not len(at):
        return at
    new = np.concatenate([[True], (key[at[1:]] != key[at[:-1]]) | (np.diff(at) > 1)])
    starts = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    last = np.append(new[1:], True) & (since >= width)
    return at[(since % width == 0) | last]


def anchors_of(words: np.ndarray, starts: np.ndarray, bands: int, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """(key, number of the text, word position, then a mark for each of the ROWS MinHashes of the next band) of every anchor in the words of several texts."""
    width = passage - SHINGLE + 1
    shingles = shingles_of(words)
    found = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0, np.int32)] for _ in range(ROWS)]
    lengths = np.diff(starts)
    if len(shingles) >= width:
        text = np.repeat(np.arange(len(lengths)), lengths)
        windows = np.flatnonzero(np.arange(len(words)) + passage <= starts[1:][text])
        made = [band_keys(shingles, width, ROWS, band) for band in range(bands)]
        for band, (key, first, _) in enumerate(made):
            # the first window of a text is always a change: the one before it reaches into the next text and is left out
            chosen = _changes(key, windows, width)
            marks = [m[chosen] for m in made[(band + 1) % bands][2]]
            for out, v in zip(found, (key[chosen].view(np.int64), text[chosen], first[chosen] - starts[text[chosen]], *marks), strict=True):
                out.append(v)
    return tuple(np.concatenate(x) for x in found)


def needed(width: int, similarity: float) -> int:
    """Shingles that two windows of ``width`` must share for this Jaccard similarity."""
    return math.ceil(similarity * 2 * width / (1 + similarity) - 1e-9)


def shifted(a: np.ndarray, b: np.ndarray, width: int, least: int) -> tuple[np.ndarray, tuple[int, int, int, int] | None]:
    """The windows of a that share ``least`` shingles with any window of b, wherever these are, and their span in a and b.

    a, b: the shingles around one collision. A shingle counts as often as both windows have it.
    """
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = code[: len(a)], code[len(a) :]
    n = int(code.max()) + 1
    times_a, times_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    once = (times_a == 1) & (times_b == 1)
    same = in_a[:, None] == in_b[None, :]
    sums = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    sums[1:, 1:] = (same & once[in_a][:, None]).cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)
    shared = sums[width:, width:] - sums[:-width, width:] - sums[width:, :-width] + sums[:-width, :-width]
    for v in np.flatnonzero((times_a > 0) & (times_b > 0) & ~once):
        of_a, of_b = (np.concatenate([[0], np.cumsum(x == v)]) for x in (in_a, in_b))
        shared += np.minimum.outer(of_a[width:] - of_a[:-width], of_b[width:] - of_b[:-width]).astype(np.int32)
    good = shared >= least
    mine, theirs = good.any(axis=1), np.flatnonzero(good.any(axis=0))
    if not len(theirs):
        return mine, None
    at = np.flatnonzero(mine)
    inside = same[at[0] : at[-1] + width, theirs[0] : theirs[-1] + width]
    rows, columns = np.flatnonzero(inside.any(axis=1)), np.flatnonzero(inside.any(axis=0))
    return mine, (int(at[0] + rows[0]), int(at[0] + rows[-1]) + SHINGLE, int(theirs[0] + columns[0]), int(theirs[0] + columns[-1]) + SHINGLE)


#: What a row of SPANS is: a span whose copy is in a larger document, in a smaller one, in the same one; or a window that is left,
#: from start, with its digests as end and key; or a run of windows with one key that the key's first document has no copy of (OPEN) or a copy that
#: isn't equal (NEAR), with the anchor's place as start and 32 bits of each of its shingles, the first at low.
FIRST, COPY, SAME, LEFT, OPEN, NEAR = range(6)
SPANS = "doc_id long, start long, end long, key long, kind long, low long, shingles array<int>"


class _Stretches:
    """The stretches of one side of a batch of comparisons, hashed in one go."""

    def __init__(self, raw: list[bytes]):
        self.shingles = shingles_of(np.frombuffer(b"".join(raw), "<u4"))
        self.at = np.cumsum([0, *(len(x) // 4 for x in raw)])
        self.length = np.maximum(0, np.diff(self.at) - SHINGLE + 1)


def on_diagonals(a: _Stretches, b: _Stretches, pair: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the diagonal, place in a, place in b), a row for each place of diagonals (pair, a's place minus b's)."""
    first, last = np.maximum(0, shift), np.minimum(a.length[pair], b.length[pair] + shift)
    length = np.maximum(0, last - first)
    number = np.repeat(np.arange(len(pair)), length)
    along = np.arange(len(number)) - np.repeat(np.cumsum(length) - length, length) + first[number]
    return number, a.at[pair][number] + along, b.at[pair][number] + along - shift[number]


def _most_in_a_window(place: np.ndarray, windows: np.ndarray, width: int, at_once: int = 1000) -> np.ndarray:
    """For each window of a: the most of its shingles that one window of b holds. place: where each shingle of a is in b, or -1."""
    out = [np.zeros(0, np.int64)]
    for k in range(0, len(windows), at_once):
        found = place[windows[k : k + at_once, None] + np.arange(width)]
        found = np.where(found < 0, -(np.arange(width) + 1) * 2 * width, found)  # each of those that are nowhere far from all
        apart = found[:, None, :] - found[:, :, None]
        out.append(((apart >= 0) & (apart < width) & (found[:, :, None] >= 0)).sum(axis=2).max(axis=1))
    return np.concatenate(out)


def _repeats(values: np.ndarray) -> np.ndarray:
    """Which values come more than once."""
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    return times[code] > 1


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    edge = np.flatnonzero(np.diff(at) > 1)
    return (at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])]) if len(at) else (at, at)


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after another."""
    return np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())


def _verify(passage: int, similarity: float, recall: float):
    """Compares the stretch ``a`` of a document with the stretch ``b`` of a smaller one (or of the same).

    Windows are held against each other on the diagonals of the hits first. Of those that this leaves open and that have a key
    of the hits (words may have been inserted or deleted), each shingle is looked up in b. Where shingles come more than once,
    so that one place for each isn't enough to tell, windows are compared with all of b's around the hit.
    """
    width = passage - SHINGLE + 1
    least, bands = needed(width, similarity), bands_for(ROWS, similarity, recall)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, mates, lows, m_lows = (batch.column(c).to_numpy() for c in ("doc_id", "mate", "low", "m_low"))
        a, b = (_Stretches(batch.column(c).to_pylist()) for c in ("a", "b"))
        hits = batch.column("hits").flatten()
        pos, mate_pos, key, label, others = (hits.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("hits").offsets.to_numpy()))
        p, r = pos - lows[of], mate_pos - m_lows[of]
        owner = np.repeat(np.arange(batch.num_rows), np.diff(a.at))[: len(a.shingles)]
        n = max(0, len(a.shingles) - width + 1)
        whole = np.arange(n) - a.at[owner[:n]] + width <= a.length[owner[:n]]
        good, equal, spans = np.zeros(n, bool), np.zeros(n, bool), []  # spans: pair, start and end in a, start and end in b, key

        _, one = np.unique(of * (1 << 34) + (p - r), return_index=True)
        number, in_a, in_b = on_diagonals(a, b, of[one], (p - r)[one])
        same = a.shingles[in_a] == b.shingles[in_b]
        sums = np.concatenate([[0], np.cumsum(same)])
        ends = np.arange(len(number)) + width
        fits = ends <= len(number)
        fits[fits] = number[ends[fits] - 1] == number[fits]
        at = np.flatnonzero(fits)
        at = at[sums[at + width] - sums[at] >= least]
        good[in_a[at]] = True
        equal[in_a[at[sums[at + width] - sums[at] == width]]] = True
        start, end = _runs(at)
        shared = np.flatnonzero(same)
        low, high = shared[np.searchsorted(shared, start)], shared[np.searchsorted(shared, end + width) - 1]
        spans.append((of[one][number[low]], in_a[low], in_a[high] + SHINGLE, in_b[low], in_b[high] + SHINGLE, label[one][number[low]]))

        # where each shingle of a is in b, on the diagonal that has most
        place = np.full(len(a.shingles), -1)
        by_size = shared[np.argsort(np.bincount(number[shared], minlength=len(one))[number[shared]], kind="stable")]
        place[in_a[by_size]] = in_b[by_size]
        open_, left, runs = np.flatnonzero(whole & ~good), np.zeros(0, np.int64), []
        tag = _mixed(np.arange(batch.num_rows, dtype=np.uint64))
        asked = key.view(np.uint64) ^ tag[of]
        made = [band_keys(a.shingles, width, ROWS, band) for band in range(bands)] if (whole & ~equal).any() else []
        if len(open_):
            own = [keys[open_] ^ tag[owner[open_]] for keys, *_ in made]
            met = open_[np.any([np.isin(k, asked) for k in own], axis=0)]
            # shingles of documents with such windows that are on no diagonal are looked for anywhere in b
            lost = np.flatnonzero((place < 0) & np.isin(owner, owner[met]))
            owner_b = np.repeat(np.arange(batch.num_rows), np.diff(b.at))[: len(b.shingles)]
            tagged = b.shingles ^ tag[owner_b]
            order = np.argsort(tagged)
            where = np.minimum(np.searchsorted(tagged[order], a.shingles[lost] ^ tag[owner[lost]]), max(0, len(order) - 1))
            found = tagged[order[where]] == a.shingles[lost] ^ tag[owner[lost]] if len(order) else np.zeros(0, bool)
            place[lost[found]] = order[where[found]]
            count = np.concatenate([[0], np.cumsum(place >= 0)])
            enough = met[count[met + width] - count[met] >= least]
            more = enough[_most_in_a_window(place, enough, width) >= least]
            good[more] = True
            if len(more):
                start, end = _runs(more)
                known = np.flatnonzero(place >= 0)
                low, high = known[np.searchsorted(known, start)], known[np.searchsorted(known, end + width) - 1]
                first_hit = np.searchsorted(of, owner[start])
                spans.append((owner[start], low, high + SHINGLE, np.minimum(place[low], place[high]), np.maximum(place[low], place[high]) + SHINGLE, label[first_hit]))
            again = np.concatenate([[0], np.cumsum(_repeats(a.shingles ^ tag[owner]) | np.isin(a.shingles ^ tag[owner], tagged[_repeats(tagged)]))])
            unclear = enough[~good[enough] & (again[enough + width] > again[enough])]
            spans += _looked_for(a, b, p, r, label, of, unclear, owner, good, width, least)
            # equal windows have equal keys in every band, and so meet the same document in the first: there both are left
            left = open_[np.isin(own[0], asked[others.astype(bool)])]
            left = left[~good[left]]
        many = np.unique(asked[others.astype(bool)])
        for keys, places, _ in made if len(many) else []:
            for kind, some in ((OPEN, whole & ~good), (NEAR, whole & good & ~equal)):
                w = np.flatnonzero(some)
                w = w[np.isin(keys[w] ^ tag[owner[w]], many)]
                if len(w):
                    edge = np.flatnonzero((np.diff(w) > 1) | (keys[w[1:]] != keys[w[:-1]]) | (owner[w[1:]] != owner[w[:-1]]))
                    runs.append((kind, w[np.concatenate([[0], edge + 1])], w[np.concatenate([edge, [len(w) - 1]])], keys, places))

        pair, s, e, ms, me, x = (np.concatenate(c).astype(np.int64) for c in zip(*spans, strict=True))
        s, e, ms, me = s - a.at[pair] + lows[pair], e - a.at[pair] + lows[pair], ms - b.at[pair] + m_lows[pair], me - b.at[pair] + m_lows[pair]
        copy = ids[pair] > mates[pair]
        rows = [(ids[pair], s, e, x, np.where(copy, COPY, SAME)), (mates[pair], ms, me, x, np.where(copy, FIRST, SAME))]
        if len(left):
            pair, some = owner[left], np.lib.stride_tricks.sliding_window_view(a.shingles, width)[left]
            rows.append((ids[pair], left - a.at[pair] + lows[pair], digests(some, 1), digests(some, 0), np.full(len(left), LEFT)))
        without = sum(len(r[0]) for r in rows)
        lows_of, held, lengths = [np.zeros(without, np.int64)], [np.zeros(0, np.int32)], [np.zeros(without, np.int64)]
        for kind, first, last, keys, places in runs:
            pair = owner[first]
            stop = last + width
            rows.append((ids[pair], places[first] - a.at[pair] + lows[pair], np.zeros(len(first), np.int64), keys[first].view(np.int64), np.full(len(first), kind)))
            lows_of.append(first - a.at[pair] + lows[pair])
            held.append((a.shingles[_ranges(first, stop - first)] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            lengths.append(stop - first)
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)]
        none = np.arange(sum(map(len, lows_of))) < without
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)), mask=pa.array(none))
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(lows_of), mask=none), shingles], ["doc_id", "start", "end", "key", "kind", "low", "shingles"])

    def verify(batch: pa.RecordBatch):
        hits, offsets = batch.column("hits").flatten(), batch.column("hits").offsets.to_numpy()
        of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        diagonals = np.unique(of * (1 << 34) + hits.field(0).to_numpy() - hits.field(1).to_numpy()) + (1 << 33) >> 34
        sizes = sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) // 4 for c in ("a", "b"))
        work = sizes * (1 + np.bincount(diagonals, minlength=batch.num_rows))
        step = np.cumsum(work) // PLACES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield compare(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(x, y - x)]) for c in batch.columns], names=batch.schema.names))

    return verify


def _looked_for(a: _Stretches, b: _Stretches, p: np.ndarray, r: np.ndarray, label: np.ndarray, of: np.ndarray, windows: np.ndarray, owner: np.ndarray, good: np.ndarray, width: int, least: int) -> list[tuple]:
    """Spans of the windows that share enough with b around a hit, wherever it is; marks them in good. For windows whose shingles
    come more than once, so that one place for each doesn't tell."""
    spans = []
    bounds = np.searchsorted(of, np.arange(len(a.length) + 1))
    for k in np.unique(owner[windows]).tolist():
        mine, theirs = (x.shingles[x.at[k] : x.at[k] + x.length[k]] for x in (a, b))
        pending = windows[np.searchsorted(windows, a.at[k]) : np.searchsorted(windows, a.at[k + 1])] - a.at[k]
        hits = slice(bounds[k], bounds[k + 1])
        while len(pending):
            low, high = int(pending[0]), min(int(pending[0]) + width, len(mine) - width + 1) - 1
            inside = np.flatnonzero((p[hits] >= low) & (p[hits] < high + width))
            for h in inside if len(inside) else [int(np.abs(p[hits] - low).argmin())]:
                t = int(r[hits][h])
                r_low = max(0, t - width + 1)
                if not good[a.at[k] + pending[pending <= high]].all() and len(theirs[r_low : t + width]) >= width:
                    moved, span = shifted(mine[low : high + width], theirs[r_low : t + width], width, least)
                    good[a.at[k] + low : a.at[k] + high + 1] |= moved
                    if span:
                        spans.append(tuple(np.array([v]) for v in (k, a.at[k] + low + span[0], a.at[k] + low + span[1], b.at[k] + r_low + span[2], b.at[k] + r_low + span[3], label[hits][h])))
            pending = pending[pending > high]
    return spans


def _parts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each stretch of overlapping spans, cut into what has a copy in a smaller document and what stays; of the latter,
    words too few for a shingle beside a copy are not listed."""
    rows = []
    for doc, key, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "spans")), strict=True):
        start, end = min(s["start"] for s in spans), max(s["end"] for s in spans)
        across, at, cut = any(s["kind"] != SAME for s in spans), start, []
        for x, y in sorted((s["start"], s["end"]) for s in spans if s["kind"] == COPY):
            if cut and x <= cut[-1][1]:
                cut[-1][1] = max(cut[-1][1], y)
            else:
                cut.append([x, y])
        for x, y in cut:
            rows += [(doc, key, at, x, True, across)] * (x - at >= SHINGLE) + [(doc, key, x, y, False, across)]
            at = y
        rows += [(doc, key, at, end, True, across)] * (end - at >= (SHINGLE if cut else 1))
    kinds = [pa.int64()] * 4 + [pa.bool_()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "key", "start_word", "end_word", "keep", "across"])


def _colliding(anchors: DataFrame, work: Workspace) -> DataFrame:
    """The anchors whose key comes more than once, with how often it does. Keys are counted by themselves first, so that
    the anchors of the others, which are nearly all, are shuffled once only. Tables of keys grow with the corpus: they are joined by
    shuffles at every size (the hints "merge"), so that a small corpus is worked on as a large one is."""
    keys = work.save(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    found = work.save(anchors.join(keys.hint("merge"), "key"), "colliding")
    work.drop(keys)
    return found


def _one_text_each(source: DataFrame, work: Workspace) -> DataFrame:
    """Of rows with one doc_id, the one with the least text. Only repeated ids have their texts moved."""
    repeated = work.save(source.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return source
    least = source.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return source.join(repeated, "doc_id", "left_anti").unionByName(least)


def _compared(colliding: DataFrame, held: DataFrame, verify, passage: int, work: Workspace) -> DataFrame:
    """SPANS of the comparisons of each colliding anchor with the first document that has its key, and with the first that has its
    key and its marks, one or all.

    A comparison takes the stretches of both documents around the hits, not the whole of them. Of a document that many are
    compared with, copies are dealt out.
    """
    marks = [c for c in colliding.columns if c.startswith("mark")]
    named = [colliding.select("doc_id", "pos", "key", "n", F.col("key").alias("label"))]
    # what a key's few members are compared with anyway needs no second look
    named += [colliding.where("n > 2").select("doc_id", "pos", "key", "n", F.xxhash64("key", F.lit(i), *some).alias("label")) for i, some in enumerate([*([m] for m in marks), marks])]
    first = named[0].groupBy("label").agg(F.min("doc_id").alias("mate"), F.max("doc_id").alias("last")).where("mate < last").select("label", "mate")
    met = [named[0].join(work.save(first, "first").hint("merge"), "label")]
    finer = reduce(DataFrame.unionByName, named[1:])
    first = finer.groupBy("label", "key").agg(F.min("doc_id").alias("mate"), F.max("doc_id").alias("last")).where("mate < last")
    # where the first in a finer group is the key's own first, its members are compared with it already
    known = work.save(met[0].groupBy("key").agg(F.min("mate").alias("known")), "known")
    first = work.save(first.join(known.hint("merge"), "key").where("mate <> known").select("label", "mate"), "first-finer")
    met.append(finer.join(first.hint("merge"), "label"))
    placed = work.save(reduce(DataFrame.unionByName, [m.select("doc_id", "pos", "key", "label", "n", "mate") for m in met]), "placed")
    mates = work.save(placed.where("doc_id = mate").groupBy("label").agg(F.min("pos").alias("mate_pos")), "mates")
    members = placed.join(mates.hint("merge"), "label").where("doc_id <> mate or pos <> mate_pos")
    found = _verified(members, held, verify, passage, work)
    work.drop(first, known, placed, mates)
    return found


def _verified(members: DataFrame, held: DataFrame, verify, passage: int, work: Workspace) -> DataFrame:
    """SPANS of the comparisons of places (doc_id, pos, mate, mate_pos, key, label, n)."""
    hit = F.struct("pos", "mate_pos", "key", "label", ((F.col("n") > 2) & (F.col("key") == F.col("label"))).alias("others"))
    stretch = F.floor(F.col("pos") / STRETCH)
    pairs = members.groupBy("doc_id", "mate", stretch.alias("stretch"), F.floor(F.col("mate_pos") / STRETCH).alias("m_stretch")).agg(
        F.collect_list(hit).alias("hits"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("mate_pos").alias("m_low"), F.max("mate_pos").alias("m_high")
    )
    pairs = work.save(pairs.withColumn("low", F.greatest(F.lit(0), F.col("low") - passage)).withColumn("m_low", F.greatest(F.lit(0), F.col("m_low") - passage)), "pairs")

    def cut(words, low, high):
        return F.substring(words, 4 * F.col(low) + 1, 4 * (F.col(high) + passage + SHINGLE - F.col(low)))

    mine = join_dealt(pairs, held, "doc_id", ["mate", "stretch", "m_stretch"], work).withColumn("a", cut("words", "low", "high")).drop("words")
    both = join_dealt(mine, held.select(F.col("doc_id").alias("mate"), F.col("words").alias("m_words")), "mate", ["doc_id", "stretch", "m_stretch"], work, pairs)
    both = both.select("doc_id", "mate", "hits", "low", "m_low", "a", cut("m_words", "m_low", "m_high").alias("b"))
    found = work.save(map_arrow(both, verify, SPANS), "verified")
    work.drop(pairs)
    return found


def _hopeful(width: int, lost: int):
    """Runs (key, kind, doc_id, pos, low, shingles, own) cut to the windows that have at most ``lost`` shingles of their own, which are
    null then, with a digest of the others and of their places."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, own = batch.column("shingles"), batch.column("own")
        length, at = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        shingles, low = lists.flatten().to_numpy(), batch.column("low").to_numpy()
        row, of = (np.repeat(np.arange(batch.num_rows), n) for n in (length, pc.fill_null(pc.list_value_length(own), 0).to_numpy()))
        place = own.flatten().to_numpy() - low[of]
        inside = (place >= 0) & (place < length[of])
        single = np.zeros(len(shingles), bool)
        single[at[of[inside]] + place[inside]] = True
        sums = np.concatenate([[0], np.cumsum(single)])
        w = np.flatnonzero(np.arange(len(shingles)) - at[row] + width <= length[row])
        w = w[sums[w + width] - sums[w] <= lost]
        edge = np.flatnonzero((np.diff(w) > 1) | (row[w[1:]] != row[w[:-1]]))
        first, last = (w[np.concatenate([[0], edge + 1])], w[np.concatenate([edge, [len(w) - 1]])]) if len(w) else (w, w)
        stop = last + width
        mixed = np.where(single, np.uint64(0), _mixed(shingles.view(np.uint32).astype(np.uint64) + np.uint64(1)))
        upto, weighed = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mixed, mixed * np.arange(len(shingles), dtype=np.uint64)))
        plain = upto[stop] - upto[first]
        content = _mixed(_mixed(weighed[stop] - weighed[first] - first.astype(np.uint64) * plain) ^ _mixed(plain) + (last - first).astype(np.uint64)).view(np.int64)
        some, held = pa.array(row[first]), _ranges(first, stop - first)
        kept = [batch.column(c).take(some) for c in ("key", "kind", "doc_id", "pos")]
        shared = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stop - first)]).astype(np.int32)), pa.array(shingles[held], mask=single[held]))
        return pa.RecordBatch.from_arrays([*kept, pa.array(low[row[first]] + first - at[row[first]]), shared, pa.array(content)], ["key", "kind", "doc_id", "pos", "low", "shingles", "content"])

    return cut


def _asked(width: int, lost: int):
    """(key, doc_id, pos, shingle): of every window of runs (key, doc_id, pos, length, held (nth, shingle, n)) so many of its rarest shingles that one that is similar has one of them."""

    def rarest(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, length = batch.column("held").flatten(), batch.column("length").to_numpy()
        at = np.cumsum(length) - length
        row, of = (np.repeat(np.arange(batch.num_rows), n) for n in (length, np.diff(batch.column("held").offsets.to_numpy())))
        many, shingle = np.full(len(row), -1, np.int64), np.zeros(len(row), np.int32)
        place = at[of] + held.field("nth").to_numpy()
        many[place], shingle[place] = held.field("n").to_numpy(), held.field("shingle").to_numpy()
        windows = np.flatnonzero(np.arange(len(row)) - at[row] + width <= length[row])
        chosen = np.zeros(len(row), bool)
        for k in range(0, len(windows), WINDOWS_AT_ONCE):
            some = windows[k : k + WINDOWS_AT_ONCE]
            # those that are a document's own come first in the order, are among the ones that may be missing, and are left out
            order = np.argsort(many[some[:, None] + np.arange(width)], axis=1, kind="stable")[:, : lost + 1]
            chosen[some[:, None] + order] = True
        found = np.flatnonzero(chosen & (many >= 0))
        kept = [batch.column(c).take(pa.array(row[found])) for c in ("key", "doc_id", "pos")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(shingle[found])], ["key", "doc_id", "pos", "shingle"])

    return rarest


def _still_open(verified: DataFrame, passage: int, similarity: float, work: Workspace) -> DataFrame:
    """(doc_id, pos, mate, mate_pos, key, label, n): of each key, the runs that its first document has no copy of, with each other and with
    those that it has a near copy of, if they may be similar.

    A window shares all but ``lost`` of its shingles with one that is similar. One with more that no other document of the key has is
    similar to none, so runs are cut to the other windows. Runs that are equal but for such shingles are similar to each other, and to the same
    others: each is held against the first of them, and two of them stand for all. What is left meets by shingles: of a window's, less its own, so many of the
    rarest that one that is similar can't lack all of them.
    """
    width = passage - SHINGLE + 1
    lost = width - needed(width, similarity)

    def of_open_keys(runs: DataFrame) -> DataFrame:
        keys = runs.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("kind").alias("least"))
        keys = work.save(keys.where((F.col("low") < F.col("high")) & (F.col("least") == OPEN)).select("key"), "keys-open")
        return runs.join(keys.hint("merge"), "key")

    runs = verified.where(F.col("kind") >= OPEN).select("key", "kind", "doc_id", F.col("start").alias("pos"), "low", "shingles")
    runs = work.save(of_open_keys(runs), "runs-open")
    places = runs.select("key", "doc_id", "low", F.posexplode("shingles").alias("nth", "shingle")).select("key", "shingle", "doc_id", (F.col("low") + F.col("nth")).cast("int").alias("place"))
    held = places.groupBy("key", "shingle").agg(*(f(c).alias(f"{name}_{c}") for c in ("doc_id", "place") for name, f in (("min", F.min), ("max", F.max))))
    # of a shingle that comes more than twice in one document the places between count as another's: that keeps more only
    own = held.where("min_doc_id = max_doc_id").select("key", F.col("min_doc_id").alias("doc_id"), F.explode(F.array_distinct(F.array("min_place", "max_place"))).alias("place"))
    own = own.groupBy("key", "doc_id").agg(F.collect_list("place").alias("own"))
    cut = map_arrow(runs.join(own.hint("merge"), ["key", "doc_id"], "left"), _hopeful(width, lost), "key long, kind long, doc_id long, pos long, low long, shingles array<int>, content long")
    hopeful = work.save(cut, "hopeful")
    work.drop(runs)
    cut = work.save(of_open_keys(hopeful), "runs-cut")
    work.drop(hopeful)
    place = F.struct("doc_id", "pos", "low", "shingles")
    groups = cut.groupBy("key", "content").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.min("kind").alias("kind"))
    groups = work.save(groups.select("key", "content", "kind", F.when(F.col("one.doc_id") < F.col("other.doc_id"), F.array("one", "other")).otherwise(F.array("one")).alias("two")), "groups")
    first = groups.select("key", "content", F.col("two")[0]["doc_id"].alias("mate"), F.col("two")[0]["pos"].alias("mate_pos"))
    repeats = cut.where(F.col("kind") == OPEN).select("key", "content", "doc_id", "pos").join(first.hint("merge"), ["key", "content"]).where("doc_id <> mate or pos <> mate_pos")
    repeats = work.save(repeats.select("key", "doc_id", "pos", "mate", "mate_pos").distinct(), "repeats")
    work.drop(cut)
    runs = groups.select("key", "kind", F.explode("two").alias("at")).select("key", "kind", "at.*")

    shingles = runs.select("key", "kind", "doc_id", "pos", "low", F.size("shingles").alias("length"), F.posexplode("shingles").alias("nth", "shingle")).where("shingle is not null")
    counted = shingles.where(F.col("kind") == OPEN).join(shingles.groupBy("key", "shingle").agg(F.count("*").alias("n")).hint("merge"), ["key", "shingle"])
    counted = counted.groupBy("key", "doc_id", "pos", "low", "length").agg(F.collect_list(F.struct("nth", "shingle", "n")).alias("held"))
    asked = work.save(map_arrow(counted.select("key", "doc_id", "pos", "length", "held"), _asked(width, lost), "key long, doc_id long, pos long, shingle int"), "asked")
    left = asked.select("key", "shingle", F.col("doc_id").alias("a_doc_id"), F.col("pos").alias("a_pos"))
    once = (F.col("doc_id") < F.col("a_doc_id")) | ((F.col("kind") == NEAR) & (F.col("doc_id") > F.col("a_doc_id")))
    met = left.join(shingles.select("key", "shingle", "kind", "doc_id", "pos").hint("merge"), ["key", "shingle"]).where(once)
    after = F.col("a_doc_id") > F.col("doc_id")
    ends = [F.when(after, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in (("doc_id", "a_doc_id", "doc_id"), ("pos", "a_pos", "pos"), ("mate", "doc_id", "a_doc_id"), ("mate_pos", "pos", "a_pos"))]
    met = work.save(met.select("key", *ends).distinct(), "met")
    # the first one may come again in its document
    again = repeats.where("doc_id = mate").select("key", "doc_id", F.col("mate_pos").alias("pos"), F.col("pos").alias("further"))
    again = met.join(again.hint("merge"), ["key", "doc_id", "pos"]).select("key", "doc_id", F.col("further").alias("pos"), "mate", "mate_pos")
    met = met.unionByName(repeats).unionByName(again).distinct()
    return work.save(met.select("doc_id", "pos", "mate", "mate_pos", "key", F.col("key").alias("label"), F.lit(2).cast("long").alias("n")), "met-open")


def _equal(left: DataFrame, passage: int, work: Workspace) -> DataFrame:
    """SPANS of the windows that are left and that another document has too, by both digests. Equal ones need no comparison."""
    same = ["key", "end"]
    keys = left.groupBy("key").agg(F.min("doc_id").alias("mate"), F.max("doc_id").alias("last")).where("mate < last").select("key")
    met = work.save(left.join(work.save(keys, "equal-keys"), "key").distinct(), "met")  # most windows meet no other
    shared = work.save(met.groupBy(*same).agg(F.min("doc_id").alias("mate"), F.max("doc_id").alias("last")).where("mate < last").select(*same, "mate"), "shared")
    members = work.save(met.join(shared, same).select("doc_id", "start", *same, "mate"), "equal")
    first = members.where("doc_id = mate").groupBy(*same).agg(F.min("start").alias("mate_start"))
    kind = F.when(F.col("doc_id") > F.col("mate"), COPY).when(F.col("start") == F.col("mate_start"), FIRST).otherwise(SAME)
    return members.join(first, same).select("doc_id", "start", (F.col("start") + passage).alias("end"), "key", kind.cast("long").alias("kind"))


def _parts_of(texts: pa.Array, at_once: int = BYTES_AT_ONCE):
    """(first, texts): slices of about ``at_once`` bytes."""
    step = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
    return [(a, texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, cluster_id, keep): the spans that repeat across documents.

    Words are separated by ASCII white space and compared without regard to the case of A-Z; ends are exclusive. keep is
    false for words whose verified copy is in a smaller doc_id, so that a copy of them stays there or, by its own copy, in a
    still smaller one; other parts of the cluster's spans are true and stay (of fewer than SHINGLE words beside a removal
    they have no row). A null id or text takes no part, nor does a text with fewer words than a passage. Rows with one
    doc_id are one document, the first in the order of their texts. Other columns are ignored; an empty table gives an empty
    result. A further copy within a document of a passage that repeats across documents is given too.
    """
    work = Workspace(docs.sparkSession, "passages")
    bands = bands_for(ROWS, similarity, recall)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    source = _one_text_each(source, work)

    def anchor(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy()
        for first, some in _parts_of(batch.column("text")):
            key, text, pos, *marks = anchors_of(*word_hashes(some), bands, passage)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[first + text]), pa.array(pos.astype(np.int32)), *map(pa.array, marks)], ["key", "doc_id", "pos", *(f"mark{k}" for k in range(ROWS))])

    anchors = work.save(map_arrow(source, anchor, "key long, doc_id long, pos int, " + ", ".join(f"mark{k} int" for k in range(ROWS))), "anchors")
    colliding = _colliding(anchors, work)
    work.drop(anchors)
    wanted = work.save(colliding.select("doc_id").distinct(), "wanted")

    def words(batch: pa.RecordBatch):
        for first, some in _parts_of(batch.column("text")):
            hashes, starts = word_hashes(some)
            raw, cuts = hashes.astype("<u4", copy=False).tobytes(), (4 * starts).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(some)), pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "words"])

    once = source.join(wanted, "doc_id")
    held = work.save(map_arrow(once, words, "doc_id long, words binary"), "words")
    verify, span = _verify(passage, similarity, recall), ["doc_id", "start", "end", "key", "kind"]
    verified = _compared(colliding, held, verify, passage, work)
    work.drop(colliding)
    more = _verified(_still_open(verified, passage, similarity, work), held, verify, passage, work)
    work.drop(held)
    left = verified.where(F.col("kind") == LEFT).select("doc_id", "start", "end", "key")
    found = verified.unionByName(more).where(F.col("kind") < LEFT).select(span).unionByName(_equal(left, passage, work))

    order = Window.partitionBy("doc_id").orderBy("start", "end", "key")
    open_end = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.distinct().withColumn("new", F.when(F.col("start") < open_end, 0).otherwise(1)).withColumn("last_key", F.lag("key").over(order))
    runs = work.save(runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))), "runs")
    links = runs.where("new = 0 and key <> last_key").select(F.col("key").alias("src"), F.col("last_key").alias("dst"))
    component = work.save(connected_components(links, work), "components")
    whole = runs.groupBy("doc_id", "run").agg(F.min("key").alias("key"), F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    parts = map_arrow(whole.select("doc_id", "key", "spans"), _parts, "doc_id long, key long, start_word long, end_word long, keep boolean, across boolean")
    named = work.save(parts.join(component, parts["key"] == component["node"], "left").select("doc_id", "start_word", "end_word", F.coalesce("component", "key").alias("cluster_id"), "keep", "across"), "named")
    across = work.save(named.where("across").select("cluster_id").distinct(), "across")
    return named.join(across, "cluster_id").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "cluster_id", "keep")
