"""URL filter, token counts, packing, leaks and nearest neighbours on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fixtures import corpus, sentence
from pyspark.sql import functions as F

from shelfgrid.llm import nearest as module
from shelfgrid.llm.common import new_folder
from shelfgrid.llm.decontaminate import find_leaks
from shelfgrid.llm.nearest import nearest
from shelfgrid.llm.packing import integer_patterns, pack, padded, token_ids
from shelfgrid.llm.token_counts import count_tokens
from shelfgrid.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string"


def test_url_rules(spark):
    rules = spark.createDataFrame(
        [("block", "example.com", "/a/"), ("allow", "www.example.com", "/a/"), ("block", "net", "/x"), ("block", None, "/")],
        "action string, host string, path string",
    )
    urls = [
        ("http://EXAMPLE.com/a/b?q", "example.com", "/a/b", "example.com/a/", "block"),
        ("http://www.example.com/a/", "www.example.com", "/a/", "www.example.com/a/", "allow"),
        ("http://badexample.com/a/", "badexample.com", "/a/", None, "allow"),
        ("http://b.net/xyz", "b.net", "/xyz", "net/x", "block"),
        ("http://b.net#/x", "b.net", "", None, "allow"),
        ("b.net/x", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(u[0], "old") for u in [*urls, urls[0]]], "url string, verdict string")
    out = filter_urls(pages, rules).select("url", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, out)) == Counter([*urls, urls[0]])
    assert filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls) + 1
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_token_cache(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows, cache = corpus(), new_folder(spark, "cache")
    docs = spark.createDataFrame(rows, SCHEMA)
    count = sentencepiece.SentencePieceProcessor(model_file=model)
    expected = sorted((i, len((t or "").encode()), len(count.encode(t or ""))) for i, t in rows)
    for _ in range(2):  # the second run finds all counts
        out = count_tokens(docs, model, cache).select("doc_id", "n_bytes", "n_tokens").collect()
        assert sorted(map(tuple, out)) == expected
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(9).cast("long")).limit(0).count()
    assert count_tokens(docs.limit(0), model, cache).count() == 0


def test_rank_file_gives_the_same_ids():
    texts = [t or "" for _, t in corpus()] + ["<|endoftext|> a", "  \n\n x'll 12,5 €", "日本語   x"]
    files = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    one, two = (list(map(list, token_ids(f)(texts))) for f in files)
    assert one == two


@pytest.mark.parametrize("char", [" ", "\n"])
def test_texts_that_tiktoken_refuses_are_packed(spark, char):
    vocabulary, text = public_tokenizers.path("byte_bpe_50k.tiktoken"), "one" + char * 1_500_000 + "two"
    ids = [*token_ids(public_tokenizers.path("byte_bpe_50k.json"))([text])[0], 0]
    out = pack(spark.createDataFrame([(1, text), (2, "short")], SCHEMA), vocabulary).where("doc_id = 1").orderBy("start").collect()
    pieces = [np.array(ids[at:at + 1024], "<u4") for at in range(0, len(ids), 1024)]
    assert [(r["start"], r["length"], r["ids_crc32"]) for r in out] == [(1024 * i, len(p), zlib.crc32(p.tobytes())) for i, p in enumerate(pieces)]


def test_packing_round_trip(spark):
    rows = corpus()
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = pack(spark.createDataFrame(rows, SCHEMA), vocabulary, capacity=256).toPandas()
    expected = Counter()
    for (doc_id, _), ids in zip(rows, token_ids(vocabulary)([t or "" for _, t in rows])):
        ids = np.array([*ids, 0], "<u4")
        for start in range(0, len(ids), 256):
            piece = ids[start:start + 256]
            expected[doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter(map(tuple, out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].values.tolist())) == expected
    for _, sequence in out.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence.offset) == [0, *sequence.length.cumsum()[:-1]] and sequence.length.sum() <= 256
    assert sorted(set(out.sequence_id)) == list(range(out.sequence_id.nunique()))
    assert pack(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_patterns_hold_the_demand(n):
    rng = random.Random(n)
    demand = Counter(rng.randrange(1, 257) for _ in range(n))
    patterns = integer_patterns(dict(demand), 256)
    held, padding = Counter(), 0
    for pattern, count in patterns:
        for length, k in pattern.items():
            held[length] += k * count
        padding += padded(sum(a * k for a, k in pattern.items()), 256) * count
    assert held == demand
    assert n < 3000 or sum(a * k for a, k in demand.items()) > 0.99 * padding


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    items = [(1, sentence(rng, 25)), (2, sentence(rng, 10)), (3, "Kurz und gut"), (4, None), (5, "..."), (6, sentence(rng, 12))]
    items.append((7, items[0][1]))
    rows = corpus()
    rows[0] = (0, "x " + items[0][1].upper() + " y kurz, UND gut. " + items[1][1])
    rows[2] = (2, " ".join(items[0][1].split()[:9]) + " no " + " ".join(items[5][1].split()[1:11]))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return word.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[p:p + n]), set()).add(str(i))
    expected = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if at := windows.get(tuple(w[p:p + n])):
                    found |= at
                    hit |= set(range(p, p + n))
        expected.append((doc_id, len(w), len(hit), len(found), bool(hit)))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    out = find_leaks(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    assert sorted(map(tuple, out)) == sorted(expected)
    assert find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    assert find_leaks(docs.limit(0), bench).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1))
    x[100:200] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    odd = [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (404, [float("inf")] * 8), (405, [1.0])]
    vectors = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>")
    out = nearest(vectors, F.col("vec_id") % 20 == 0, k=20).toPandas()
    hits = 0
    for q in range(0, 400, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:20]
        own = out[out.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [x[v] @ x[q] for v in own.vec_id], rtol=1e-12)
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 400
    few = nearest(vectors.where("vec_id < 5"), F.col("vec_id") == 0, k=20)
    assert few.count() == 4
    assert nearest(vectors.where("vec_id > 399"), F.lit(True)).count() == 0


@pytest.mark.parametrize("share", [0.1, 1 / 3])
def test_nearest_outside_a_cluster(spark, share):
    rng = np.random.default_rng(5)
    n, d = 4000, 32
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    inside = rng.random(n) < share
    x[inside] = x[0] + 0.01 * rng.normal(size=(inside.sum(), d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    out = nearest(vectors, F.col("vec_id") % 20 == 0, k=20).toPandas()
    found = {q: set(own.vec_id) for q, own in out.groupby("query_id")}
    recall = {False: [], True: []}
    for q in range(0, n, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert len(found[q]) == 20
        recall[bool(inside[q])].append(len(found[q] & set(np.argsort(-score)[:20])) / 20)
    assert np.mean(recall[False]) > 0.9 and np.mean(recall[True]) > 0.9


def test_nearest_searches_return_little(spark, monkeypatch):
    """More blocks do not make a search return more rows: what cannot be among the nearest stays in its block."""
    rng = np.random.default_rng(9)
    n, searched, write = 6000, [], module.written

    def noted(df, name):
        out = write(df, name)
        if name == "vector-hits":
            searched.append(out.count())
        return out

    monkeypatch.setattr(module, "written", noted)
    x = rng.normal(size=(n, 16))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    out = nearest(vectors, F.col("vec_id") % 100 == 0, k=20, sample=200, block=64).toPandas()
    assert searched[0] < 60 * 300  # 222,100 when each block returned its 21 best
    score = x[::100] @ x.T
    score[np.arange(60), np.arange(60) * 100] = -np.inf
    best = {i * 100: set(np.argsort(-s)[:20]) for i, s in enumerate(score)}
    found = {q: set(own.vec_id) for q, own in out.groupby("query_id")}
    assert all(len(found[q]) == 20 for q in best)
    assert np.mean([len(found[q] & best[q]) / 20 for q in best]) > 0.9
