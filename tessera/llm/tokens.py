"""Token ids of whole texts, by the tokenizers library, with each distinct piece of text encoded once per worker.

Both vocabularies here cut a text into pieces before they merge anything, and a merge never crosses a cut. A text is
therefore cut at places where the library is certain to cut as well, each distinct piece is given to the library once,
and the ids are joined. A text in which such a place is not certain goes to the library whole. ``tests/llm`` hold the
result against the library's own over awkward texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that a worker keeps in each of two generations. It bounds memory only: a piece that has been dropped is encoded again. An
#: entry takes some 300 bytes, and in a corpus of many rare words nearly every piece is one.
PIECES_KEPT = 60_000
#: Bytes of text that are cut and looked up at once. What these hold that is new is kept beside the entries.
BYTES_AT_ONCE = 1_000_000
#: A space is a certain cut for the byte-level vocabulary if something other than white space follows.
_UNSURE_SPACE = r" (?:[\s\pZ\x0b\x1c-\x1f\x{85}]|\z)|\x01"
#: White space to some, but not to the library.
_SEPARATORS = r"[\x01\x1c-\x1f]"
#: A character that stands between pieces; a text that holds it goes to the library whole.
_MARK = "\x01"


def _table(chars: bytes) -> np.ndarray:
    held = np.zeros(256, bool)
    held[np.frombuffer(chars, np.uint8)] = True
    return held


_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_STOP = _table(b",.;:!?")
#: Bytes with which white space may begin; what follows decides.
_MAYBE_SPACE = _table(bytes([*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]))


def certain_cuts(raw: np.ndarray) -> np.ndarray:
    """For each byte of texts without unsure places, whether both vocabularies cut before it: at a space, at a stop between
    a letter and white space, and on both sides of a line break between a letter or stop and a letter."""
    cut = raw == 32
    if len(raw) > 2:
        at, line = np.flatnonzero(_STOP[raw[1:-1]]) + 1, np.flatnonzero(raw[1:-1] == 10) + 1
        line = line[(_LETTER | _STOP)[raw[line - 1]] & _LETTER[raw[line + 1]]]
        cut[line] = cut[line + 1] = True
        cut[at[_LETTER[raw[at - 1]] & ((raw[at + 1] == 32) | (raw[at + 1] == 10) & cut[at + 1])]] = True
    return cut


@lru_cache(maxsize=8)
def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: a changed file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts (and the end), and the bytes of all."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1 + texts.offset)[texts.offset :] if offsets is not None else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


class PieceEncoder:
    """encode(texts) -> for each text its ids, as little-endian unsigned 32-bit bytes. Null is taken as empty.

    Special strings in a text are treated as the library does by default; no begin or end tokens are added.
    """

    def __init__(self, path: str, kept: int = PIECES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept = kept
        added = self.library.get_added_tokens_decoder()
        special = "|".join(re.escape(t.content) for t in added.values())
        # the byte-level vocabulary keeps white space, the other drops it
        self.spaced = self._ids([" a"]) != self._ids(["a"])
        self.unsure = f"{special}|{_UNSURE_SPACE if self.spaced else _SEPARATORS}"
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.mark = f" {_MARK} "
        self.begins = np.array([(self.library.id_to_token(i) or "")[:1] == "\u0120" for i in range(self.library.get_vocab_size())])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str], between: str, at_once: int = 1000) -> list[bytes]:
        """As _ids(), for pieces that are cut safely: they go to the library in a few strings.

        between: "" for pieces that begin with a space, if white space is kept: only tokens that begin such a piece do.
        Otherwise something that no piece holds stands between pieces, and its ids tell where to cut.
        """
        out: list[bytes] = []
        mark = np.frombuffer(self._ids([between])[0], "<u4")
        for e in self.library.encode_batch_fast([between.join(pieces[k : k + at_once]) for k in range(0, len(pieces), at_once)], add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            raw = ids.tobytes()
            if between:
                cuts = (4 * (np.flatnonzero(ids == mark[-1]) + 1)).tolist()
                out += [raw[a:b] for a, b in zip([0, *cuts], [*(c - 4 * len(mark) for c in cuts), len(raw)], strict=True)]
            else:
                cuts = (4 * np.flatnonzero(self.begins[ids])).tolist()
                out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def _kind(self, piece: str) -> int:
        """0: a string of its own; 1: begins with a space; 2: one word without white space, which may follow a line break."""
        if not self.spaced:
            return 2
        return 1 if piece[:1] == " " else 2 if piece.isascii() and piece.isalpha() else 0

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from what the worker has kept or from the library."""
        if len(self.pieces) > self.kept:  # what doesn't come again goes, when the next generation is full
            self.pieces, self.older = {}, self.pieces
        found = list(map(self.pieces.get, pieces))
        at: tuple[list[int], ...] = ([], [], [])
        for i, ids in enumerate(found):
            if ids is None:
                if (ids := self.older.get(pieces[i])) is None:
                    at[self._kind(pieces[i])].append(i)
                else:
                    found[i] = self.pieces[pieces[i]] = ids
        for kind, some in enumerate(at):
            new = [pieces[i] for i in some]
            made = self._ids_of_pieces(new, "" if kind == 1 else "\n" if self.spaced else self.mark) if kind else self._ids(new)
            self.pieces.update(zip(new, made, strict=True))
            for i, x in zip(some, made, strict=True):
                found[i] = x
        return found

    def _unsure(self, texts: pa.Array, raw: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts in which a cut is not certain. What can't match is left out before the pattern is tried."""
        maybe = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        odd = np.flatnonzero((raw[:-1] == 32) & _MAYBE_SPACE[raw[1:]]) if self.spaced else np.flatnonzero((raw >= 28) & (raw <= 31))
        odd = np.concatenate([odd, np.flatnonzero(raw == 1), ends[ends > 0] - 1])
        odd = odd[(raw[odd] <= 32)] if len(raw) else odd[:0]
        maybe[np.searchsorted(ends, odd, side="right")] = True
        at = pa.array(np.flatnonzero(maybe))
        found = np.zeros(len(texts), bool)
        found[at.to_numpy()[pc.match_substring_regex(texts.take(at), self.unsure).to_numpy(zero_copy_only=False)]] = True
        return found

    def _some(self, texts: pa.Array) -> list[bytes]:
        starts, raw = _content(texts)
        unsure = self._unsure(texts, raw, starts[1:])
        whole = dict(zip(at := np.flatnonzero(unsure).tolist(), self._ids(texts.take(pa.array(at, pa.int64())).to_pylist()), strict=True))
        if whole:
            starts, raw = _content(pc.if_else(pa.array(unsure), "", texts))
        cut = certain_cuts(raw)
        cut[starts[:-1][starts[:-1] < len(raw)]] = True
        cuts = np.append(np.flatnonzero(cut), len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        ids = pa.array(self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(pieces.indices)
        _, ends, data = ids.buffers()
        data = memoryview(data) if data is not None else b""
        bounds = np.frombuffer(ends, np.int32, len(ids) + 1)[np.searchsorted(cuts, starts)].tolist() if len(ids) else [0] * (len(texts) + 1)
        return [whole[k] if k in whole else bytes(data[x:y]) for k, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False))]

    def encode(self, texts: pa.Array | list[str | None]):
        """Yields the bytes of each text in turn, so that ids of a large batch are not held at once."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts, "")
        step = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // BYTES_AT_ONCE
        first = 0
        for last in [*(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]:
            if last > first:
                yield from self._some(texts.slice(first, last - first))
            first = last


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    return PieceEncoder(path)
