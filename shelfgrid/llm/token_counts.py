"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shelfgrid.llm.common import exists, text_or_empty

CACHE = StructType([
    StructField("digest", BinaryType()), StructField("tokenizer", StringType()), StructField("n_tokens", LongType()),
])


def tokenizer_version(model: str) -> str:
    """Digest of the vocabulary file: another file is another version, whatever its name."""
    return hashlib.sha256(Path(model).read_bytes()).hexdigest()


@lru_cache(maxsize=4)
def _processor(model: str):
    if model.endswith(".model"):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        return lambda texts: [len(x) for x in loaded.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(model)
    loaded.no_truncation()
    loaded.no_padding()
    return lambda texts: [len(x) for x in loaded.encode_batch_fast(texts, add_special_tokens=False)]


def _encoder(model: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _processor(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # few texts at a time: token lists are larger than the texts
                part = batch.slice(start, 256)
                n = count(part.column("_text").to_pylist())
                yield pa.record_batch(
                    [part.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                    names=["digest", "tokenizer", "n_tokens"],
                )

    return encode


def count_tokens(docs: DataFrame, model: str, cache: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model`` is a vocabulary file that every executor has (``.model`` for sentencepiece, ``.json`` for tokenizers) and
    ``cache`` a folder all executors share, made when missing. The content is normalised no further than the count allows:
    null counts as empty. Its SHA-256 and the vocabulary's digest are the cache key. Digests that the cache has are not
    encoded again; of the others each distinct text is encoded once and its count appended to the cache. Two runs that
    append the same digest do no harm: equal keys have equal counts and are read as one. Repeated rows each get a row;
    an empty table gives an empty result; columns named like a new one are replaced.

    Copies are folded before the shuffle, so a text that a third of the rows share travels once a task. When counts come
    back, such a text is a skewed join side, which Spark splits.
    """
    spark, version = docs.sparkSession, tokenizer_version(model)
    keyed = docs.drop("n_bytes", "n_tokens", "over_limit", "digest", "_text").withColumns({
        "_text": text_or_empty(text), "n_bytes": F.octet_length(text_or_empty(text)).cast("long"),
        "digest": F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)),
    })

    def cached() -> DataFrame:
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    texts = keyed.select("digest", "_text").dropDuplicates(["digest"])
    if exists(spark, cache):
        texts = texts.join(cached(), "digest", "left_anti")
    texts.mapInArrow(_encoder(model, version), CACHE).write.mode("append").parquet(cache)
    rows = keyed.drop("_text", text).join(cached(), "digest")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
