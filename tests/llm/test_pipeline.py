"""The pipeline's stages on the small table: what each keeps, against brute force; and the SQL twins."""

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from fixtures import components, corpus, repeats, sentence
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline  # noqa: E402

from shelfgrid.llm.common import table, written  # noqa: E402
from shelfgrid.llm.packing import token_ids  # noqa: E402
from shelfgrid.llm.queries import spark_queries, sql_queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    stages = dict(pipeline.STAGES)
    kept = written(stages["toxicity"](spark, docs, DATA), "t1")
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()  # 87 labels may be too few to reject anything
    unique = written(stages["n-gram Jaccard join"](spark, kept, DATA), "t2")
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(i for i, _, c in components(rows) if i == c)
    cut = written(stages["suffix-array dedup"](spark, unique, DATA), "t3")
    rows = [(r["doc_id"], r["text"]) for r in unique.collect()]
    removed = {i: n for i, _, n, _, _ in repeats(rows)}
    before = dict(rows)
    for r in cut.collect():
        assert (r["text"] == before[r["doc_id"]]) == (removed[r["doc_id"]] == 0)
        assert r["n_chars"] == len(r["text"])
    clean = written(stages["benchmark decontamination"](spark, cut, DATA), "t4")
    assert clean.columns == docs.columns and clean.count() <= cut.count()
    packed = stages["packing"](spark, clean, DATA)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_null_ids_and_copies_survive_once(spark):
    rows = [(None, "a b c d e f g", "en", "s", 13), (7, "one two three four five six", "en", "s", 27), (7, "one two three four five six", "en", "s", 27), (8, None, "en", "s", 0), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.without_near_copies(spark, docs, DATA).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["7", "8", "9", "None"]


def _planted(spark, folder):
    """Tables in ``folder``, and which of the documents are toxic and which are benchmark texts."""
    rng = random.Random(8)
    tail = sentence(rng, 50)
    items = [(1, sentence(rng, 25)), (2, sentence(rng, 10)), (3, "Kurz und gut")]
    rows = corpus()[:-1]
    rows += [(200 + i, "caf" + c + tail + f" {i}\ufffd " + sentence(rng, 40)) for i, c in enumerate("\u00e9\u0129")]  # of equal last bytes
    rows += [(210, "x y " + items[0][1].upper() + " z"), (211, "so kurz, UND gut."), (212, "in front " + " ".join(items[1][1].split()[:9]))]
    nasty = [(300 + i, f"you are a nasty person number {i} and {sentence(rng, 3)}") for i in range(60)]
    nasty += [(400, "such a n a s t y person"), (401, "what a n4sty person"), (402, "a nastyyyy person")]
    fine = [(500 + i, f"this is a fine day number {i} and {sentence(rng, 3)}") for i in range(120)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows + nasty + fine]
    labels = [(i, 0, 1) for i, _ in nasty if i < 400] + [(i, 1, 0) for i, _ in fine]
    for name, values, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return rows + nasty + fine, {i for i, _ in nasty}, items


def _cut(rows, length=200):
    """Texts without the characters that have a byte in a repeated string."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, text), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept, at = "", 0
        for c in text or "":
            n = len(c.encode())
            kept, at = kept if any(gone[at:at + n]) else kept + c, at + n
        out.append((doc_id, kept if any(gone) else text))
    return out


def _leaks(text, items):
    def words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))

    own = words(text)
    for w in (words(t) for _, t in items):
        n = min(len(w), 10)
        windows = {tuple(w[p:p + n]) for p in range(len(w) - n + 1)}
        if any(tuple(own[p:p + n]) in windows for p in range(len(own) - n + 1)):
            return True
    return False


def _pieces(rows):
    out = Counter()
    ids = token_ids(public_tokenizers.path("byte_bpe_50k.json"))([t or "" for _, t in rows])
    for (doc_id, _), tokens in zip(rows, ids, strict=True):
        tokens = np.array([*tokens, 0], "<u4")
        for at in range(0, len(tokens), 1024):
            piece = tokens[at:at + 1024]
            out[doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(tokens)] += 1
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows, toxic, items = _planted(spark, str(tmp_path))
    stages, folder = dict(pipeline.STAGES), str(tmp_path)

    def staged(name, given):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
        return stages[name](spark, docs, folder)

    def texts(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    left = [r for r in rows if r[0] not in toxic]
    assert texts(staged("toxicity", rows)) == sorted(left, key=str)
    least = {i for i, _, c in components(left) if i == c}
    left = [r for r in left if r[0] in least or not (r[1] or "").split()]
    left = _cut(left)
    assert sum("\ufffd" in (t or "") for _, t in left) == 2 and all(t.startswith(f"caf{i - 200}\ufffd") for i, t in left if i in (200, 201))
    clean = [r for r in left if not _leaks(r[1], items)]
    assert texts(staged("benchmark decontamination", left)) == sorted(clean, key=str)
    assert {210, 211} == {i for i, _ in left} - {i for i, _ in clean}
    out = pipeline.run(spark, folder).toPandas()
    found = out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].values.tolist()
    assert Counter(map(tuple, found)) == _pieces(clean)
    for _, sequence in out.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence.offset) == [0, *sequence.length.cumsum()[:-1]] and sequence.length.sum() <= 1024


@pytest.mark.parametrize("name", sorted(sql_queries()))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = spark_queries()[name](spark, DATA)
    cursor = con.execute(sql_queries()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(str, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


def test_every_document_is_judged(spark):
    docs = table(spark, DATA, "documents").select("doc_id")
    for name in ("op5_toxicity", "op7_quality_classifier"):
        out = spark_queries()[name](spark, DATA)
        assert out.select("doc_id").exceptAll(docs).count() == 0 == docs.exceptAll(out.select("doc_id")).count()
        assert out.where(~F.col("score").between(0, 1)).count() == 0
