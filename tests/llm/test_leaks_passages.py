import random
import time
from collections import defaultdict

from tessera.llm import decontaminate, passages
from tessera.llm.decontaminate import BenchmarkIndex, edit_budget, normalised
from tessera.llm.queries import QUERIES

from .conftest import ODD


def slow_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_edited_items_against_full_alignment(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index, rng, long = BenchmarkIndex(tuple(items)), random.Random(3), [t for t in texts.values() if len(t) > 400]
    for _ in range(60):
        item_id, item = rng.choice(items)
        item = normalised(item)
        budget, s = edit_budget(len(item)), list(item)
        for _ in range(rng.randint(0, budget + 3)):
            p, kind = rng.randrange(len(s)), rng.randrange(3)
            s[p : p + (kind != 1)] = [rng.choice("xyzuv")] if kind else []
        text = normalised(f"{rng.choice(long)[:120]} {''.join(s)} {rng.choice(long)[:150]}")
        edits, hits = slow_distance(item, text), [h for h in index.search([text]) if h[1] == item_id]
        assert bool(hits) == (edits <= budget) and all(h[4] == edits for h in hits[:1])


def test_other_scripts_repeats_and_long_texts():
    rng = random.Random(8)
    chinese = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items = [(k, chinese(200)) for k in range(100)]
    edited = list(items[7][1])
    for p in (10, 60, 110, 150):
        edited[p] = "\u7532"
    text = chinese(700) + items[3][1] + chinese(4000) + "".join(edited) + "\u00e9" * 50
    began = time.perf_counter()
    got = list(BenchmarkIndex(tuple(items)).search([text, chinese(5000), "plain"]))
    assert [(k, i, e) for k, i, _, _, e in got] == [(0, 3, 0), (0, 7, 4)] and got[0][2:4] == (700, 900) and got[1][2:4] == (4900, 5100)
    same = BenchmarkIndex(((1, "a" * 200), (2, "ab" * 100), (3, "a" * 200), (None, "x" * 7)))
    hits = list(same.search(["b" * 50 + "a" * 1000, "a" * 1_000_000, "ab" * 3000, "c" * 100_000]))
    assert {(k, i) for k, i, *_ in hits} == {(0, 1), (0, 3), (1, 1), (1, 3), (2, 2)}
    assert sum(k == 0 and i == 1 for k, i, *_ in hits) == 5 and all(e == 0 for k, _, _, _, e in hits if k < 2)
    prose = " ".join(f"w{rng.randrange(10**6)}" for _ in range(140_000))
    item = prose[500_000:500_200]
    assert [h[1] for h in BenchmarkIndex(((5, item),)).search([prose])] == [5]
    assert time.perf_counter() - began < 60


def test_places_are_those_of_the_text_as_given():
    item = "the quick brown fox jumps over the lazy dog and runs"
    for text in ("  A\n\n" + item.upper().replace(" ", "  \t") + " end", "\u0130stanbul  \u0130 " + item + "!", item):
        (_, _, a, b, e), = BenchmarkIndex(((1, item),)).search([text])
        assert normalised(text[a:b]) == item and e == 0
    cut = item.replace("brown ", "")
    (_, _, a, b, e), = BenchmarkIndex(((1, item * 3),), 0.1).search([f"zz {cut}{item}{cut} yy"])
    assert f"zz {cut}{item}{cut} yy"[a:b] == f"{cut}{item}{cut}" and e == 12


def test_leaks_of_a_table(spark, sf, texts):
    items = {r.item_id: normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_benchmark_decontamination"](spark, sf).collect()}
    assert {(d, i) for d, t in texts.items() for i, b in items.items() if b in normalised(t)} <= got


def test_odd_documents_and_items(spark, odd, empty, make):
    items = spark.createDataFrame([(1, "same text here"), (2, None), (3, ""), (None, "b c"), (5, "SAME   text\nhere")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.find_leaks(odd, items).collect()), key=str)
    assert got == sorted([(d, i, 0, 14, 0) for d in (4, 4, 5) for i in (1, 5)] + [(None, None, 2, 5, 0)], key=str)
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(odd, items.limit(0)).count() == 0
    clean = decontaminate.without_leaks(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 4


def slow_repeats(words_of, n=51):
    owners = defaultdict(set)
    for d, w in words_of.items():
        for i in range(len(w) - n + 1):
            owners[tuple(w[i : i + n])].add(d)
    need = defaultdict(set)
    for d, w in words_of.items():
        for i in range(len(w) - n + 1):
            if len(owners[tuple(w[i : i + n])]) > 1:
                need[d].update(range(i, i + n))
    return need


def test_every_exact_repeat_is_found(spark, make, texts):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, rows = prose(53), {d: t for d, t in list(texts.items())[:80]}
    for d in range(1000, 1040):  # a passage in the middle of forty documents
        a = prose(rng.randint(0, 90))
        rows[d] = " ".join(a + shared + prose(rng.randint(0, 90)))
    for d in range(2000, 2030):
        rows[d] = " ".join(prose(200))
    short = prose(40)
    rows[3000], rows[3001] = " ".join(prose(60) + short + prose(60)), " ".join(prose(70) + short + prose(20))
    near = prose(80)
    rows[3100], rows[3101] = " ".join(near), " ".join(near[:40] + ["other"] + near[41:])
    docs = make([*rows.items(), (None, rows[1000]), (4000, None), (4001, "")])
    got = defaultdict(set)
    result = passages.repeated_passages(docs).collect()
    for r in result:
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word
    for d, words in slow_repeats({d: t.encode().lower().split() for d, t in rows.items()}).items():
        # a word by which a passage that the first document has too is longer in two others lies outside of what all share
        assert len(words - got[d]) <= 3
    for d in range(1000, 1040):
        at = next(i for i in range(len(rows[d])) if rows[d].split()[i : i + 53] == shared)
        assert set(range(at, at + 53)) <= got[d]
    assert not got.keys() & {*range(2000, 2030), 3000, 3001, 4000, 4001, None}
    assert {3100, 3101} <= got.keys()
    clusters = {r.cluster_id for r in result if 1000 <= r.doc_id < 1040}
    assert len(clusters) == 1 and [r.doc_id for r in result if r.cluster_id in clusters and r.keep] == [1000]


def test_bands_and_empty(empty, odd):
    assert passages.bands_for(1, 0.8, 0.95) == 2 and passages.bands_for(2, 0.8, 0.95) == passages.bands_for() == 3 and passages.bands_for(4) == 6 and passages.bands_for(4, 1.0) == 1
    assert passages.repeated_passages(empty).count() == 0 and passages.repeated_passages(odd).count() == 0


def found_words(docs):
    got, kept = defaultdict(set), defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        kept[r.doc_id].update(range(r.start_word, r.end_word) if r.keep else ())
    return got, kept


def test_passage_that_the_first_document_has_a_part_of_only(make):
    rng, rows, trials = random.Random(11), {}, 40
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    for t in range(trials):
        shared, n = prose(60), 40 + 5 * (t % 2)
        parts = [shared[10 : 10 + n], shared, shared]
        if t % 4 > 1:  # the second agrees with the first, beside what it shares with the third
            head = prose(60)
            parts = [head + shared[:20], head + shared, shared]
        for k, part in enumerate(parts):
            rows[10 * t + k] = " ".join(prose(70) + part + prose(70))
        rows[10 * t + 3] = " ".join(prose(70) + parts[0] + prose(70))  # several that share the short one
    got, kept = found_words(make([*rows.items()]))
    for t in range(trials):
        at = 70 + 60 * (t % 4 > 1)
        assert set(range(at, at + 60)) <= got[10 * t + 1] and set(range(70, 130)) <= got[10 * t + 2]
        assert not set(range(70, 130)) & kept[10 * t + 2]


def test_every_removed_word_is_kept_somewhere(make):
    rng, rows = random.Random(12), {}
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    for t in range(30):
        one, two = prose(60), prose(60)
        rows |= {10 * t: prose(30) + one + prose(30), 10 * t + 1: prose(80) + one + two + prose(9), 10 * t + 2: prose(5) + one + two + prose(80)}
    got, kept = found_words(make([(d, " ".join(w)) for d, w in rows.items()]))
    stays = {w for d, words in rows.items() for i, w in enumerate(words) if i not in got[d] - kept[d]}
    assert stays == {w for words in rows.values() for w in words}
    for t in range(30):
        assert kept[10 * t] == set(range(30, 90)) and kept[10 * t + 1] == set(range(140, 200)) and not kept[10 * t + 2]


def test_inserted_and_deleted_words(make):
    rng, rows, trials = random.Random(13), {}, 300
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    for t in range(trials):
        shared = prose((52, 60, 70)[t % 3])
        m = len(shared) // 2
        edited = shared[:m] + (prose(1) if t % 2 else []) + shared[m + (t % 2 == 0) :]
        rows |= {10 * t: prose(70) + shared + prose(70), 10 * t + 1: prose(90) + edited + prose(60)}
    got, kept = found_words(make([(d, " ".join(w)) for d, w in rows.items()]))
    for n in range(3):
        assert sum(bool(got[10 * t + 1]) for t in range(n, trials, 3)) >= 0.93 * trials / 3


def test_exact_repeats_in_stock_sentences(make):
    """Documents made of the same 400 sentences: every passage of 51 words that repeats is found, and no other word."""
    rng = random.Random(14)
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    stock = [prose(15) for _ in range(400)]
    rows = {d: [w for _ in range(rng.randint(10, 30)) for w in rng.choice(stock)] for d in range(380)}
    for t in range(40):
        shared = prose(60)
        for d in rng.sample(range(380), 2):
            at = rng.randrange(len(rows[d]))
            rows[d] = rows[d][:at] + shared + rows[d][at:]
    got, _ = found_words(make([(d, " ".join(w)) for d, w in rows.items()]))
    need = slow_repeats(rows)
    assert all(need[d] <= got[d] for d in need)


def test_third_document_with_the_anchors_only(make):
    """A document that has the anchors of a passage, and nothing else of it, hides the passage from nobody."""
    import numpy as np

    rng, rows, used = random.Random(15), {}, {}
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    for t in range(20):
        shared = prose(60)
        words = np.array([passages.xxhash.xxh32_intdigest(w) for w in shared], np.uint32)
        _, _, at, *_ = passages.anchors_of(words, np.array([0, 60]), passages.bands_for(2))
        rows[10 * t] = [w for p in sorted(set(at.tolist())) for w in prose(30) + shared[p : p + 5]]
        rows[10 * t + 1], rows[10 * t + 2] = prose(70) + shared + prose(70), prose(70) + shared + prose(70)
    got, _ = found_words(make([(d, " ".join(w)) for d, w in rows.items()]))
    for t in range(20):
        assert got[10 * t + 1] == got[10 * t + 2] == set(range(70, 130)) and not got[10 * t]


def test_repeated_ids_and_long_texts(make):
    rng = random.Random(16)
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    shared, long = prose(60), prose(30_000)
    rows = [(1, prose(20) + shared), (1, prose(20) + shared), (2, long[:15_000] + shared + long[15_000:]), (3, long), (4, ["x"] * 60_000), (5, ["x"] * 300)]
    got, kept = found_words(make([(d, " ".join(w)) for d, w in rows]))
    assert got[1] == set(range(20, 80)) and set(range(30_060)) - got[2] == set() and got[3] == set(range(30_000))
    assert not kept[3] and set(range(300)) <= got[5] and got[4]


def test_near_copies_in_stock_sentences(make):
    """80 pairs of four stock sentences, one word changed, among 1,200 documents made of the same 60 sentences."""
    rng = random.Random(17)
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    stock = [prose(15) for _ in range(60)]
    rows = {d: [w for _ in range(rng.randint(10, 30)) for w in rng.choice(stock)] for d in range(1200)}
    where, wanted = rng.sample(range(1200), 160), []
    for t in range(80):
        shared = [w for s in rng.sample(stock, 4) for w in s]
        for d, words in ((where[2 * t], shared), (where[2 * t + 1], [*shared[: (m := rng.randrange(60))], *prose(1), *shared[m + 1 :]])):
            at = 15 * rng.randrange(len(rows[d]) // 15)
            rows[d] = rows[d][:at] + words + rows[d][at:]
            wanted.append((d, at))
    grams = lambda words: [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    def alike(a, b):  # of the windows of both passages
        windows = [[set(grams(w[i : i + 51])) for i in range(10)] for w in (a, b)]
        return max(len(x & y) / len(x | y) for x in windows[0] for y in windows[1]) >= 0.8

    got, _ = found_words(make([(d, " ".join(w)) for d, w in rows.items()]))
    pairs = [(wanted[2 * t], wanted[2 * t + 1]) for t in range(80)]
    pairs = [x for x in pairs if alike(*(rows[d][at : at + 60] for d, at in x))]
    found = sum(all(len(got[d] & set(range(at, at + 60))) >= 46 for d, at in x) for x in pairs)
    assert len(pairs) > 60 and found >= 0.9 * len(pairs), (found, len(pairs))


def test_no_colliding_near_copy_is_lost(make):
    """Near copies in stock sentences, as above: all that collide in a band are found, whatever documents have their keys first."""
    import numpy as np

    rng = random.Random(17)
    prose = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    stock = [prose(15) for _ in range(40)]
    rows = {d: [w for _ in range(rng.randint(10, 30)) for w in rng.choice(stock)] for d in range(600)}
    where, wanted = rng.sample(range(300, 600), 160), []
    for t in range(80):
        shared = [w for s in rng.sample(stock, 4) for w in s]
        for d, words in ((where[2 * t], shared), (where[2 * t + 1], [*shared[: (m := rng.randrange(60))], *prose(1), *shared[m + 1 :]])):
            at = 15 * rng.randrange(len(rows[d]) // 15)
            rows[d] = rows[d][:at] + words + rows[d][at:]
            wanted.append((d, at))

    def keys(words):
        shingles = passages.shingles_of(np.array([passages.xxhash.xxh32_intdigest(w) for w in words], np.uint32))
        return shingles, [passages.band_keys(shingles, 47, passages.ROWS, band)[0] for band in range(passages.bands_for())]

    def collide(a, b):
        (x, ka), (y, kb) = keys(a), keys(b)
        return any(p == q and len(np.intersect1d(x[i : i + 47], y[j : j + 47])) >= 42 for m, n in zip(ka, kb) for i, p in enumerate(m) for j, q in enumerate(n))

    got, _ = found_words(make([(d, " ".join(w)) for d, w in rows.items()]))
    pairs = [(wanted[2 * t], wanted[2 * t + 1]) for t in range(80)]
    pairs = [x for x in pairs if collide(*(rows[d][at : at + 60] for d, at in x))]
    lost = [x for x in pairs if any(len(got[d] & set(range(at, at + 60))) < 46 for d, at in x)]
    assert len(pairs) > 60 and not lost, (len(lost), len(pairs))


def test_pairs_grow_with_a_group_of_near_copies(make, monkeypatch):
    """A passage behind other words, with a word changed in every second document: its first document is like few of the others."""
    counts, save = [], passages.Workspace.save

    def counted(self, df, name="table"):
        table = save(self, df, name)
        if name == "met-open":
            counts.append(table.count())
        return table

    monkeypatch.setattr(passages.Workspace, "save", counted)
    rng = random.Random(3)
    tail = [f"v{rng.randrange(10**9)}" for _ in range(56)]
    rows = []
    for d in range(360):
        words = [f"o{rng.randrange(10**9)}" for _ in range(60)] + tail
        for at in (75, 100) if d == 0 else (rng.randrange(60, 116),) if d % 2 else ():
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((d, " ".join(words)))
    for n in (120, 360):
        got, kept = found_words(make(rows[:n]))
        assert all(not set(range(66, 110)) & kept.get(d, set()) and set(range(66, 110)) <= got[d] for d in range(4, n, 2))
    assert counts[1] <= 4 * counts[0], counts
