"""Lexical search against plain scoring of every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from fixtures import corpus, sentence
from pyspark.sql import functions as F

from shelfgrid.llm.lexical_search import Shard, search, terms_of

SCHEMA = "doc_id long, text string"


def brute(docs, items, k=20):
    def terms(text):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(list)
    for i, text in items:
        asked[i] += terms(text)
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            weights = ((math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))), c[t]) for t in words if c[t])
            scores.append((-sum(w * (1_000_000_000 * tf // (1000 * tf + 12 * m)) for w, tf in weights), i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1):
            out.append((item, rank, i if known else None, -score))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search(spark):
    rng = random.Random(2)
    rows = [*corpus(), (None, "alpha1 beta2"), (7001, "alpha1 beta2"), (7000, "ALPHA1, beta2!"), *[(8000 + i, "gamma3 delta4 copy") for i in range(40)]]
    items = [(i, sentence(rng, rng.randrange(1, 40))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "alpha1 beta2 beta2"), (24, "copy delta4"), (25, "copy"), (25, "gamma3"), (None, "alpha1")]
    items += [(26, rows[5][1]), (27, " ".join(["straße1"] * 50))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"terms": F.lit(1), "n": F.lit("x"), "shard": F.lit(2), "score": F.lit(None).cast("string")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(3), "block": F.lit("y")})
    expected = brute(rows, items)
    assert result(search(docs, asked)) == expected
    assert result(search(docs.repartition(5), asked, shard_docs=9, block_items=4)) == expected
    assert result(search(docs, asked, k=3, shard_docs=30)) == brute(rows, items, 3)
    assert search(docs.limit(0), asked).count() == 0
    assert search(docs, asked.limit(0)).count() == 0


def test_terms():
    text = "Don't stop-ÄÖ_42 x y\n<tag>Z{é}"
    assert [t.decode() for t in terms_of(text.encode())] == ["don", "t", "stop", "ÄÖ", "42 x y", "tag", "z", "é"]


def test_reading_ends_early_and_ties_are_whole():
    rng = np.random.default_rng(4)
    n_docs, n_terms = 4000, 6
    doc_of = np.concatenate([np.sort(rng.choice(n_docs, 3000, replace=False)) for _ in range(n_terms)])
    term_of = np.repeat(np.arange(n_terms), 3000)
    for impact in (rng.integers(1, 1000, len(doc_of)) ** 3, rng.integers(1, 4, len(doc_of)), np.ones(len(doc_of), dtype=np.int64)):
        shard = Shard(doc_of, term_of, impact, n_docs, n_terms)
        times = np.array([1, 2, 1, 3, 1, 1])
        whole = np.bincount(doc_of, weights=impact * times[term_of], minlength=n_docs).astype(np.int64)
        order = np.lexsort((np.arange(n_docs), -whole))[:20]
        found, scores, entries = shard.best(np.arange(n_terms), times, 20)
        assert found.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
        one, _, read = shard.best(np.array([2]), np.array([1]), 20)
        assert read <= 3000 and len(one) == 20
    steep = np.where(np.arange(len(doc_of)) % 3000 < 40, 10**6, 1)
    assert Shard(doc_of, term_of, steep, n_docs, n_terms).best(np.array([0, 1]), np.array([1, 1]), 20)[2] < 1500
