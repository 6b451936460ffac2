import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, token_counts, token_file
from tessera.llm.queries import tokenizer_file
from tessera.llm.tokens import PieceEncoder

from .conftest import ODD

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
AWKWARD = ["", " ", "  ", "a  b", "a   b\n c", " \n x", "<|endoftext|> hi", "hi<|endoftext|>", "x\x1cy", "x\x01y", "ﬁn İ É", "don't we'll  ", "\tx y\t", "日本 語", "a ", " a b", "é ́", "a\x00b c", "1 23  456", "Foo.\nBar, baz;\n\nqux.\n", "a.\nb\nc", "\nfoo", "end,", "it's.\nIt'll", "x.\n é", "a\u2003.b \u2003c", "é,\nb", "a...\nb"]


@pytest.fixture(scope="module", params=[BYTE, WORD])
def encoder(request):
    return PieceEncoder(request.param, kept=50)


def by_library(encoder, text):
    return np.array(encoder.library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_give_the_librarys_ids(encoder, texts):
    every = AWKWARD + list(texts.values())[:60]
    assert list(encoder.encode(every)) == [by_library(encoder, t) for t in every]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'st \n\té<|>1.,　́"), max_size=30), max_size=4))
def test_any_text(texts_):
    for path in (BYTE, WORD):
        encoder = PIECES.setdefault(path, PieceEncoder(path))
        assert list(encoder.encode(texts_)) == [by_library(encoder, t) for t in texts_]


PIECES = {}


def test_many_rare_words_are_held_in_bounded_number():
    texts_ = [" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(200)]  # 400,000 distinct words
    for path in (BYTE, WORD):
        encoder, most, known = PieceEncoder(path), [], PieceEncoder._known

        def counted(pieces):
            made = known(encoder, pieces)
            most.append(len(encoder.pieces) + len(encoder.older) + len(pieces))
            return made

        encoder._known = counted
        got = list(encoder.encode(texts_))
        assert max(most) < 400_000
        assert got[::50] == [by_library(encoder, t) for t in texts_[::50]]


def test_counts(spark, odd, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(odd, BYTE, cache).collect()
    library = PieceEncoder(BYTE)
    want = Counter((i, len((t or "").encode()), len(by_library(library, t)) // 4) for i, t in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.over_limit for r in got if r.doc_id == 6} == {True}
    assert token_counts.token_counts(empty, BYTE).count() == 0
    # a second call encodes what is new only
    again = odd.unionByName(odd.sparkSession.createDataFrame([(9, "new words")], "doc_id long, text string"), allowMissingColumns=True)
    assert token_counts.token_counts(again, BYTE, cache).count() == len(ODD) + 1
    stored = spark.read.option("recursiveFileLookup", True).parquet(cache)
    assert stored.count() == len({t or "" for _, t in ODD}) + 1


def test_dac_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, top, n).astype("<u4") for top, n in ((50_257, 3000), (300, 700), (2**32, 50), (9, 0), (2**14, 1))]
    segment = token_file.Segment(token_file.encode_segment([3, None, 5, 6, 7], docs))
    flat = np.concatenate(docs)
    assert segment.doc_ids == [3, None, 5, 6, 7] and len(segment) == len(flat)
    assert (segment.ids(0, len(flat)) == flat).all()
    assert all((segment.document(k) == d).all() for k, d in enumerate(docs))
    assert all(segment[int(i)] == flat[i] for i in rng.integers(0, len(flat), 300))
    assert len(token_file.Segment(token_file.encode_segment([], []))) == 0


def test_token_file(odd, empty, monkeypatch):
    rows = sorted(token_file.token_file(odd, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    library = PieceEncoder(BYTE)
    want = Counter((i, zlib.crc32(by_library(library, t) + bytes(4))) for i, t in ODD)
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    assert token_file.token_file(empty, BYTE).count() == 0


def test_ids_are_read_from_the_written_file(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT_IDS", 100)
    path = f"file://{tmp_path}/tokens"
    token_file.write_token_file(odd, path, BYTE)
    rows = sorted(token_file.read_token_file(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    flat = [x for r in rows for x in r.ids]
    for at in (0, 5, len(flat) // 2, len(flat) - 1):
        assert token_file.read_ids(spark, path, at) == [flat[at]]
    assert token_file.read_ids(spark, path, 3, 30) == flat[3:33]
    for bad in (-1, len(flat)):
        with pytest.raises(IndexError):
            token_file.read_ids(spark, path, bad)
    assert token_file.read_document(spark, path, 4) == [r.ids for r in rows if r.doc_id == 4]


def greedy(lengths, window):
    """Best fit decreasing, one piece at a time: how many windows are left with which room."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            best = min(fits)
            room[room.index(best)] -= n
        else:
            room.append(window - n)
    return Counter(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    used = defaultdict(int)
    placed = Counter()
    for length, _, n, first, each, at in packing.plan(Counter(lengths), 20):
        for k in range(n):
            s, o = first + k // each, at + k % each * length
            assert o == used[s] and o + length <= 20
            used[s] += length
            placed[length] += 1
    assert placed == Counter(lengths)
    assert Counter(20 - u for u in used.values()) == greedy(lengths, 20)


def test_pack(odd, empty):
    rows = packing.pack(odd, WORD, window=64, with_ids=True).collect()
    library = PieceEncoder(WORD)
    per = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        per[r.sequence_id].append((r.offset, r.length))
    for pieces in per.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 64
    assert sorted(per) == list(range(len(per)))
    want = Counter()
    for i, t in ODD:
        ids = list(np.frombuffer(by_library(library, t), "<u4")) + [2]
        want.update((i, s, tuple(ids[s : s + 64])) for s in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in rows) == want
    assert packing.pack(empty, WORD).count() == 0
    assert [packing.padded_length(n) for n in (1, 3, 1024, 4096)] == [1, 4096, 1024, 4096]


def test_pack_query_loses_little(spark, sf):
    from tessera.llm.queries import QUERIES

    rows = QUERIES["op2_packing"](spark, sf).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(used.values()) / (4096 * len(used)) > 0.98
