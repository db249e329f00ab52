"""Text quality by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgrid.llm.common import text_or_empty

#: Classes of bytes: lower case, upper case, digits, blanks, line ends, bytes of non-ASCII characters, then marks one by one.
_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[0, 9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_OWN = ".,;:!?-'\"()|#$%&*/=@"
for _i, _c in enumerate(_OWN):
    _CLASS[ord(_c)] = 6 + _i
_REST = 6 + len(_OWN)
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in _OWN]] = _REST
KINDS = _REST + 1
WIDTH = KINDS * KINDS + 3


def features(text: str) -> np.ndarray:
    """Square roots of the shares of class pairs in the whole text, its log length, and the shares of repeated lines and words."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        out[:KINDS * KINDS] = np.sqrt(pairs / (len(kinds) - 1))
    lines, words = [x for x in text.split("\n") if x], text.split()
    out[-3] = np.log1p(len(raw)) / 10
    out[-2] = 1 - len(set(lines)) / len(lines) if lines else 0
    out[-1] = 1 - len(set(words)) / len(words) if words else 0
    return out


def estimate_prior(n_positive: int, n_negative: int) -> float:
    """Share of good texts among random ones, from the labelled rows, kept off 0 and 1."""
    return (n_positive + 1) / (n_positive + n_negative + 2)


def fit_nonnegative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear scores that minimise ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` under the logistic loss (Adam).

    Where the estimated risk of the negatives turns negative in a batch, the step goes back up, as the method has it.
    """
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.01
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(WIDTH), 0.0
    m, v, step = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), 0
    batch = 500
    for turn in range(rounds):
        order = rng.permutation(len(u))
        for at in range(0, len(u), batch):
            x = u[order[at:at + batch]]
            y = p[rng.integers(0, len(p), min(batch, max(len(p), 1)))]
            sp = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", y, w) + b, -30, 30)))
            su = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x, w) + b, -30, 30)))
            good = np.append(np.einsum("ij,i->j", y, sp - 1), (sp - 1).sum()) * prior / len(y)
            negative = np.append(np.einsum("ij,i->j", x, su), su.sum()) / len(x) - prior * np.append(np.einsum("ij,i->j", y, sp), sp.sum()) / len(y)
            risk = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
            slope = good + negative if risk >= 0 else -negative
            slope[:-1] += 1e-4 * w
            step += 1
            m = 0.9 * m + 0.1 * slope
            v = 0.999 * v + 0.001 * slope**2
            move = 0.01 / (1 + turn / 20) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
    w /= scale
    return w, b - float((w * mean).sum())


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 12_000, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on).

    ``labels`` has ``text`` and ``quality``; its rows of quality 1 are the trusted positives, and ``docs``, labels unseen,
    the unlabelled text. Training takes at most ``most`` rows of either, the ones with the smallest hash of their text and
    ``doc_id`` (if there is one), so copies are drawn one by one: a bounded sample for the classifier only. The class prior is estimated from all rows of ``labels``. Every whole text is
    scored. Null counts as empty; empty texts are scored like others; repeated rows get the same score; an empty table
    gives no rows; without positives every score is a half. Columns named like a new one are replaced.
    """
    def texts(frame: DataFrame, name: str) -> list:
        return [text_or_empty(name).alias("t"), F.col("doc_id") if "doc_id" in frame.columns else F.lit(None).alias("doc_id")]

    labels = labels.where("quality in (0, 1)").select(*texts(labels, "text"), F.col("quality").cast("int").alias("q"))
    seen = {r["q"]: r["n"] for r in labels.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = estimate_prior(seen.get(1, 0), seen.get(0, 0))
    docs = docs.drop("score", "predicted")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([features(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["x"])

    def sample(frame: DataFrame, there: int) -> np.ndarray:
        # The hash threshold keeps the sort small; its slack makes a shortfall all but impossible.
        share = min(1.0, 1.2 * most / max(there, 1) + 0.01)
        key = F.xxhash64("t", "doc_id")
        kept = frame.withColumn("k", key).where(F.pmod("k", F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy("k").limit(most)
        rows = kept.select("t").mapInArrow(vectors, "x binary").collect()
        return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, WIDTH)

    unlabelled = docs.select(*texts(docs, text))
    weights, bias = np.zeros(WIDTH), 0.0
    if seen.get(1) and (there := unlabelled.count()):
        weights, bias = fit_nonnegative(sample(labels.where("q = 1"), seen[1]), sample(unlabelled, there), prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [float((features(t or "") * weights).sum()) + bias for t in batch.column(text).to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(np.array(x, float), -30, 30)))
            yield pa.record_batch([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(score, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
