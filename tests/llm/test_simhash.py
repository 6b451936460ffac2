import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.operators.components import connected_components
from tessera.storage import Workspace

from .conftest import ODD


def slow_fingerprint(text, words=3):
    found = "".join(c.lower() if c < "\x80" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    w = [x for x in found.split(" ") if x]
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(marks, radius):
    """{row: smallest id reachable} of (id, fingerprint) rows."""
    parent = list(range(len(marks)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            groups[find(i)] = min(d, groups.get(find(i), d))
    return [groups.get(find(i)) for i in range(len(marks))]


def test_fingerprints(texts):
    for t in [t for _, t in ODD if t is None or len(t) < 1000] + list(texts.values())[:20]:
        assert simhash.fingerprint(t) % 2**64 == slow_fingerprint(t)


def test_whole_table_against_brute_force(spark, sf, make, texts):
    rows = list(texts.items())[:150] + [r for r in ODD if r[0] != 6]
    got = simhash.near_duplicates(make(rows), tile=8).collect()
    marks = [(d, slow_fingerprint(t)) for d, t in rows]
    want = sorted(zip([m[0] for m in marks], [m[1] for m in marks], slow_components(marks, 2), strict=True), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want


def test_links_lose_none(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    flip = np.uint64(1) << rng.integers(0, 64, (2, 300)).astype(np.uint64)
    flip[0, :40] = np.uint64(1 << 63)
    near = (base.view(np.uint64) ^ flip[0] ^ flip[1]).view(np.int64).tolist()
    every = sorted({*map(int, base), *near, 0, -1, 1, 3, 7})
    frame = spark.createDataFrame([(x,) for x in every], "fp long")
    marks = [(x, x % 2**64) for x in every]
    want = dict(zip(every, slow_components(marks, 2), strict=True))
    for blocks in (4, 8):
        work = Workspace(spark, "test")
        found = {r.node: r.component for r in connected_components(simhash.links(frame, 2, work, tile=16, blocks=blocks)).collect()}
        assert {x: found.get(x, x) for x in every} == want


def test_forest_keeps_components():
    x = np.arange(200, dtype=np.int64)
    a, b = simhash.forest(x[:, None], x[:, None], x, x, 2)
    assert len(a) < 200 * 20
    marks = [(int(v), int(v)) for v in x]
    assert set(slow_components(marks, 2)) == {0}
    parent = dict(zip(x.tolist(), x.tolist(), strict=True))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        parent[find(p)] = find(q)
    assert len({find(v) for v in parent}) == 1


def test_a_small_corpus_is_joined_as_a_large_one(make):
    stay = simhash.one_of_each(make([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)]))
    stay.collect()
    assert "BroadcastHashJoin" not in stay._jdf.queryExecution().executedPlan().toString()


def test_one_of_each(spark, make, empty, texts):
    distinct = [t for t in dict.fromkeys(texts.values()) if len(t.split()) > 300][:20]
    rows = []
    for i, t in enumerate(distinct):
        words = t.split()
        copy = words[:]
        copy[len(copy) // 2] = "changed"
        rows += [(10 * i + 5, t), (10 * i + 3, " ".join(copy)), (10 * i + 7, t), (10 * i + 7, t)]
    rows += [(None, distinct[0]), (None, "one of its own"), (900, None), (901, ""), (950, "two texts under"), (950, "one id"), (950, "one id")]
    stay = simhash.one_of_each(make(rows))
    ids = sorted(r.doc_id for r in stay.collect() if r.doc_id is not None)
    groups = {i: [d for d in ids if d // 10 == i] for i in range(len(distinct))}
    assert stay.columns == make([]).columns and 900 in ids and 901 not in ids
    assert all(len(groups[i]) <= 1 for i in range(len(distinct)))
    assert sum(groups[i] == [10 * i + 3] for i in range(len(distinct))) >= len(distinct) - 2  # near copies among the texts themselves
    assert [r.text for r in stay.collect() if r.doc_id is None] == ["one of its own"]
    assert sorted(r.text for r in stay.collect() if r.doc_id == 950) == ["one id", "two texts under"]
    assert simhash.one_of_each(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_by_brute_force(make):
    """Of pairs at a similarity of 0.8 or more nearly all lose a document, and nothing goes without such a partner."""
    rng = np.random.default_rng(2)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    rows = []
    for g in range(120):
        words = vocabulary[rng.integers(0, 3000, int(rng.integers(60, 400)))]
        rows.append((10 * g, words))
        for k in range(1, 4):
            copy = words.copy()
            copy[rng.integers(0, len(words), int(rng.integers(0, len(words) // 20)))] = "edit"
            rows.append((10 * g + k, copy))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in rows}
    near = {(d, e) for d in sets for e in range(d // 10 * 10, d // 10 * 10 + 4) if d != e and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])}
    stay = {r.doc_id for r in simhash.one_of_each(make([(d, " ".join(w)) for d, w in rows]), tile=64).collect()}
    gone = sets.keys() - stay
    assert all(any((d, e) in near for e in sets) for d in gone)
    pairs = [(d, e) for d, e in near if d < e]
    assert len(pairs) > 150 and sum(not {d, e} <= stay for d, e in pairs) >= 0.95 * len(pairs)


def test_a_text_and_its_repetitions_are_near_copies(make):
    """Similarity is that of sets of shingles, so a text said twice or thrice is a near copy of itself, and so is one with a repeated line."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts, other = {}, [" ".join(word() for _ in range(300)) for _ in range(40)]
    base = " ".join(word() for _ in range(300))
    line = " ".join(word() for _ in range(12))
    texts |= {1: base, 2: f"{base} {base}", 3: f"{base} {base} {base}", 4: f"{base} {line}", 5: " ".join([base] + [line] * 30)}
    texts |= {10 + i: t for i, t in enumerate(other)}
    left = {r.doc_id for r in simhash.one_of_each(make(list(texts.items()))).collect()}
    assert left == {1, *range(10, 50)}


def test_no_link_at_the_similarity_is_lost(make):
    """Short texts, whose fingerprints tell little, and long families of which many pairs lie about 0.8: the groups are those of all pairs."""
    rng = np.random.default_rng(5)
    rows, vocabulary = [], np.array([f"w{i}" for i in range(5000)])
    for g in range(150):  # four and five shingles
        words = vocabulary[rng.integers(0, 5000, 9)]
        rows += [words, words[:8]]
    for g in range(12):
        base = vocabulary[rng.integers(0, 5000, 150)]
        for k in range(25):
            copy = base.copy()
            copy[rng.integers(0, 150, int(rng.integers(1, 6)))] = f"e{g} {k}"
            rows.append(copy)
    line = vocabulary[:40]  # a line of many documents
    rows += [np.concatenate([line, vocabulary[rng.integers(0, 5000, 60)]]) for _ in range(60)]
    texts = [" ".join(r) for r in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    first = list(range(len(texts)))

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                low, high = sorted((find(i), find(j)))
                first[high] = low
    for tile in (16, simhash.TILE):
        stay = {r.doc_id for r in simhash.one_of_each(make(list(enumerate(texts))), tile=tile).collect()}
        assert stay == {find(i) for i in range(len(texts))}
