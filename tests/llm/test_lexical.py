"""Ranked search against a plain scoring of all documents."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    terms = lambda t: [x.translate(LOWER) for x in TERM.findall(t or "")]
    held = [(d, terms(t)) for d, t in docs]
    n, length = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked, scored = set(terms(text)), []
        for d, t in held:
            if t:
                m = 10 + (90 * len(t) * n) // length
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked & set(t))
                if s > 0:
                    scored.append((-s, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    for text in ("Ünï-code A1 b_c\x00d\x7fe 日本x\x85y Ökonom ÄB", "", " . ", "İstanbul ẞ K"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == [x.translate(LOWER) for x in TERM.findall(text)]


def test_whole_table(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op13_ranked_search']})").fetchall()
    assert found(queries.op13_ranked_search(spark, sf)) == sorted(want, key=str)


def test_odd_documents_and_items(spark, odd, make, empty):
    items = spark.createDataFrame([(1, "same TEXT"), (1, "a X é"), (2, None), (3, "…"), (4, "日本 nothing")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(lexical.ranked_search(odd, items)) == want and len(want) > 4
    assert lexical.ranked_search(empty, items).count() == 0
    assert lexical.ranked_search(odd, items.limit(0)).count() == 0
    assert lexical.ranked_search(make([(1, ""), (2, None)]), items).count() == 0


@pytest.fixture(scope="module")
def prose():
    """Documents with two vocabularies, ties, copies, and one much repeated text."""
    rng = random.Random(3)
    words = [[f"w{v}x{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)] for v in (0, 1)]
    docs = [(i, " ".join(rng.choices(words[i % 2], k=rng.randint(0, 60)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(300)] + [(i, docs[i][1]) for i in range(0, 100, 3)]
    rng.shuffle(docs)
    items = [(q, " ".join(rng.choices(words[q % 2], k=12)) if q % 3 else docs[q][1]) for q in range(40)]
    return docs, items


def test_ties_copies_and_blocks(spark, make, prose, monkeypatch):
    docs, items = prose
    df, asked = make(docs).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert found(lexical.ranked_search(df, asked)) == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 50)
    assert found(lexical.ranked_search(df, asked)) == want


def search_of(docs, items, leaf_rows=8):
    known = {t: i for i, t in enumerate(dict.fromkeys(t for _, x in items for t in lexical.terms_of(x.encode())))}
    lengths, starts, terms, tfs = [], [0], [], []
    for _, t in docs:
        every = lexical.terms_of(t.encode())
        own = sorted({known[x] for x in every if x in known})
        names = {known[x]: x for x in every if x in known}
        lengths.append(len(every))
        terms += own
        tfs += [every.count(names[x]) for x in own]
        starts.append(len(terms))
    asked = [sorted({known[t] for t in lexical.terms_of(x.encode())}) for _, x in items]
    weights = np.array([100 + 7 * (i % 90) for i in range(len(known))])
    return lexical.Search(asked, weights, 5, len(docs), max(1, sum(lengths))), (lengths, np.array(starts), np.array(terms, np.int64), np.array(tfs))


def test_bounds_hold_for_every_subtree(prose):
    docs, items = prose
    docs = docs[:600]
    search, (_, starts, terms, tfs) = search_of(docs, items)
    values = tfs * 1e5 * search.scale[terms]
    tree = lexical.BallTree(starts, terms, values, search.group, 8)
    dense = np.zeros((len(docs), len(search.weights)))
    dense[np.repeat(np.arange(len(docs)), np.diff(starts)), terms] = values
    products, bounds = dense @ search.queries, tree.bounds(search.queries, search.norms)
    assert sorted(tree.order) == list(range(len(docs)))
    for node, (low, high) in enumerate(tree.ranges):
        assert (products[tree.order[low:high]].max(axis=0) <= bounds[node]).all()


def test_subtrees_are_pruned(prose):
    """Near copies lie in small balls: most leaves are never scored, and nothing is lost by it."""
    rng = random.Random(4)
    base = [" ".join(f"b{b}t{rng.randrange(200)}" for _ in range(40)) for b in range(60)]
    docs = [(i, base[i % 60] + f" z{i}") for i in range(3000)]
    items = [(q, base[q]) for q in range(20)]
    search, (lengths, starts, terms, tfs) = search_of(docs, items)
    search.add([d for d, _ in docs], np.array(lengths), starts, terms, tfs)
    assert search.visited < 0.3 * search.leaves
    assert all(len(h) == 5 for h in search.held)


def test_share_of_leaves(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    assert 0 < lexical.visited_share(read("documents"), read("benchmark")) <= 1
