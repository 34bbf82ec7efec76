"""Ranked search against a plain scoring of every document, whatever the size of shards, samples and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from certjobs.llm import ranked_search as search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, n int, terms int, shard string, leaf int, score double", "item_id string, text string, item int, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items):
    words = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    count, total = sum(n > 0 for *_, n in words), sum(n for *_, n in words)
    held = Counter(t for _, w, _ in words for t in w)
    out = []
    for item, text in items:
        found = []
        for i, w, n in words:
            if n:
                m = 25 + 75 * n * count // total
                score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * held[t] + 1))) * (1_000_000_000 * w[t] // (1000 * w[t] + 8 * m)) for t in terms(text) if w[t])
                found += [(-score, i is not None, i, score)] if score > 0 else []
        out += [(item, k + 1, i, s) for k, (*_, i, s) in enumerate(sorted(found, key=lambda x: x[:3] if x[1] else (x[0], False, 0))[:10])]
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    topics = [[f"{'abcdefgh'[k]}{j}" for j in range(30)] for k in range(8)]
    shared = ["the", "Of", "über", "x9", "naïve"]
    docs = []
    for i in range(260):
        topic = topics[i % 8]
        docs.append((i, " ".join(r.choice(topic if r.random() < 0.7 else shared) for _ in range(r.choice([1, 3, 10, 40, 200])))))
    docs += [(1000 + i, "the a1 a2 copy, of copies") for i in range(90)]  # many alike, with equal scores
    docs += [(2000, None), (2001, ""), (2002, "--- ..."), (None, "the a1 a2 copy, of copies"), (None, "b1"), (7, "repeated id b2"), (7, "repeated id b2"), (3000, "a3 " * 5000), (3001, "ſ K ÀÉ")]
    r.shuffle(docs)
    items = [(str(k), " ".join(r.choice(topics[k % 8] + shared) for _ in range(12))) for k in range(20)]
    items += [("copies", "A1 a2 COPY copies"), ("twice", "b1 b1 b1 b2"), ("twice", "b1 b1 b1 b2"), ("none", "zzz"), ("empty", ""), (None, None), (None, "ÀÉ x9"), ("odd", "ſ K à")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 0.5) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)


def found(spark, docs, items):
    return sorted((tuple(r) for r in search.ranked_search(*frames(spark, docs, items)).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 4, "LEAF": 4, "FIRST": 1, "SAMPLE": 100, "FEATURES": 64}, {"SHARD": 30, "LEAF": 8, "FIRST": 2, "LISTED": 1, "BLOCK_TERMS": 100}])
def test_ranked_search(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(search, name, value)
    docs, items = corpus()
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus()
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None), (2, "..")], items) == found(spark, docs, [("a", "zzz")]) == []


def test_bisection_parts_topics_and_bounds_hold():
    r = np.random.default_rng(1)
    topic = r.integers(0, 4, 400)
    rows = [np.unique(r.integers(0, 50, 12) + 50 * t) for t in topic]
    cuts, flat = np.cumsum([0] + [len(x) for x in rows]), np.concatenate(rows)
    tables = search.bisection(cuts, flat, 200, 2)
    leaf = search.leaves(tables, cuts, flat)
    most = sum(np.bincount(topic[leaf == k], minlength=4).max() for k in range(4) if (leaf == k).any())
    assert [t.shape for t in tables] == [(1, 200), (2, 200)] and most > 380
    assert len(search.leaves(tables, np.array([0, 0]), np.empty(0, np.int64))) == 1


def test_few_shards_are_visited(spark, monkeypatch):
    """With topics in shards of their own, bounds rule most shards out."""
    monkeypatch.setattr(search, "SHARD", 16)
    monkeypatch.setattr(search, "LEAF", 8)
    monkeypatch.setattr(search, "FIRST", 2)
    r = random.Random(2)
    docs = [(i, " ".join(f"t{i % 16}w{r.randint(0, 40)}" for _ in range(30))) for i in range(800)]
    items = [("a", "t3w1 t3w2 t3w3 t3w4"), ("b", "t9w1 t9w5 t9w7")]
    seen = []
    scores = search.Search.scores
    assert found(spark, docs, items) == plain(docs, items)
    block = next(search.blocks(frames(spark, docs, items)[1]))
    rows = search.vectors(frames(spark, docs, items)[0], block.vocabulary)
    n, total, held = search.statistics(rows, len(block.vocabulary))
    index = search.shards(rows, search.fitted(rows, n, len(block.vocabulary)), n, total).collect()
    s = search.Search(block, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(h) + 1))) for h in held]))
    for row in index:
        bound = s.bounds(np.array(row["terms"]), np.array(row["tops"]))
        shard = {c: np.array(row[c]) for c in ("docs", "terms", "starts", "posts", "gains")}
        for i in range(2):
            assert scores(s, i, shard).max(initial=0) <= bound[i]
            seen.append(bound[i] > 0)
    assert sum(seen) <= 0.6 * len(seen)  # only documents of the two topics are indexed: each item can leave out the other topic
