"""Packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from shelfgrid.llm.common import text_or_empty, written

PIECES = StructType([StructField(n, LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
#: Groups of equal length are ranked in so many parts.
SALTS = 64


# --- tokens ---------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def token_ids(vocabulary: str, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)):
    """A function from texts to lists of ids, without added special tokens.

    ``.json`` files are read by tokenizers, ``.tiktoken`` rank files by tiktoken. Both give the same ids where they hold the
    same vocabulary (held against each other in the tests); the second takes a quarter of the time. Texts that tiktoken
    refuses (its pattern gives up on a million blanks in a row) are encoded by the ``.json`` file beside the rank file.
    """
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        loaded = Tokenizer.from_file(vocabulary)
        loaded.no_truncation()
        loaded.no_padding()
        return lambda texts: [x.ids for x in loaded.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    loaded = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))

    def ids(text: str) -> list[int]:
        try:
            return loaded.encode(text, allowed_special="all")
        except ValueError:
            return token_ids(str(Path(vocabulary).with_suffix(".json")))([text])[0]

    return lambda texts: [ids(t) for t in texts]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """The documents' token sequences (with ``end_id`` behind each) cut into full pieces and one rest each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows: list[list[int]] = [[] for _ in PIECES.names]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    tokens = np.array([*ids, end_id], dtype="<u4")
                    for start in range(0, len(tokens), capacity):
                        piece = tokens[start:start + capacity]
                        found = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(tokens))
                        for column, value in zip(rows, found, strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in rows], names=PIECES.names)

    return docs.select("doc_id", text_or_empty(text).alias("text")).mapInArrow(cut, PIECES)


# --- patterns -------------------------------------------------------------------------------------------------------

def padded(total: int, capacity: int) -> int:
    """Length of a sequence with ``total`` tokens: as it is at a power of two, else filled up to ``capacity``."""
    return total if total & (total - 1) == 0 else capacity


def price(duals: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best value of pieces that sum to each total, and the last piece taken.

    ``duals[l]`` is the value of a piece of length ``l`` (minus infinity where there is none).
    """
    best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0
    for total in range(1, capacity + 1):
        sums = best[total - 1::-1] + duals[1:total + 1]
        k = int(sums.argmax())
        best[total], last[total] = sums[k], k + 1
    return best, last


def _pattern(last: np.ndarray, total: int) -> dict[int, int]:
    """The pieces of the best pattern with this total."""
    pattern: dict[int, int] = {}
    while total:
        n = int(last[total])
        pattern[n] = pattern.get(n, 0) + 1
        total -= n
    return pattern


def starting_patterns(demand: dict[int, int], capacity: int, costs: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns, each with the length that it uses up: filled as well as the lengths still left allow, long pieces first.

    As each pattern uses up a length that no later one holds, they are a basis of the linear program.
    """
    left = {n: float(k) for n, k in demand.items()}
    values = np.full(capacity + 1, -np.inf)
    for n in left:
        values[n] = n * (1 + 0.02 * n / capacity)
    out = []
    while left:
        best, last = price(values, capacity)
        pattern = _pattern(last, int((best[1:] / costs[1:]).argmax()) + 1)
        ends = min(pattern, key=lambda n: (left[n] / pattern[n], -n))
        amount = left.pop(ends) / pattern[ends]
        values[ends] = -np.inf
        for n, k in pattern.items():
            if n != ends:
                left[n] = max(left[n] - amount * k, 0.0)
        out.append((pattern, ends))
    return out


def relaxed_patterns(demand: dict[int, int], capacity: int, tolerance: float) -> tuple[list[dict[int, int]], np.ndarray]:
    """Basic solution of the linear program "cover the demand with patterns of least padded length", and its patterns.

    Revised simplex over columns that the knapsack prices, from a basis of well filled patterns. It ends when the value is
    within ``tolerance`` of the demand's tokens (no pattern holds more than its padded length), or of the optimum by
    Farley's bound, or when the last ``m / 4 + 50`` columns together gained less than a tenth of ``tolerance``.
    """
    lengths = np.array(sorted(demand))
    row_of = {int(n): i for i, n in enumerate(lengths)}
    m = len(lengths)
    costs = np.array([np.inf, *(padded(t, capacity) for t in range(1, capacity + 1))], float)
    started = starting_patterns(demand, capacity, costs)
    patterns = [p for p, _ in started]
    cost = np.array([costs[sum(n * k for n, k in p.items())] for p in patterns])
    # Each row is one length; in the order of use the basis is lower triangular, so it is inverted row by row.
    order = [row_of[n] for _, n in started]
    columns = np.zeros((m, m))
    for j, pattern in enumerate(patterns):
        for n, k in pattern.items():
            columns[row_of[n], j] = k
    inverse = np.zeros((m, m))
    for i, row in enumerate(order):
        inverse[i, row] = 1
        for j in np.flatnonzero(columns[row, :i]):
            inverse[i] -= columns[row, j] * inverse[j]
        inverse[i] /= columns[row, i]
    wanted = np.array([demand[int(n)] for n in lengths], float)
    x = np.maximum((inverse * wanted).sum(axis=1), 0)
    y = (cost[:, None] * inverse).sum(axis=0)
    tokens, before = float((lengths * wanted).sum()), np.inf
    for turn in range(40 * m):
        if (cost * x).sum() <= (1 + tolerance) * tokens:
            break
        if turn % (m // 4 + 50) == 0:
            if (cost * x).sum() > (1 - tolerance / 10) * before:
                break
            before = (cost * x).sum()
        duals = np.full(capacity + 1, -np.inf)
        duals[lengths] = y
        best, last = price(duals, capacity)
        if (best[1:] / costs[1:]).max() <= 1 + tolerance:
            break
        total = int((best[1:] - costs[1:]).argmax()) + 1
        pattern = _pattern(last, total)
        direction = sum(k * inverse[:, row_of[n]] for n, k in pattern.items())
        rows = np.flatnonzero(direction > 1e-9)
        leaves = int(rows[(x[rows] / direction[rows]).argmin()])
        step = x[leaves] / direction[leaves]
        x = np.maximum(x - step * direction, 0)
        x[leaves] = step
        pivot = inverse[leaves] / direction[leaves]
        y = y + (costs[total] - best[total]) * pivot
        direction[leaves] = 0
        inverse -= np.outer(direction, pivot)
        inverse[leaves] = pivot
        patterns[leaves], cost[leaves] = pattern, costs[total]
    return patterns, x


def integer_patterns(demand: dict[int, int], capacity: int, tolerance: float = 0.002) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole counts that hold exactly the demand: the relaxed ones rounded down, the rest best fit decreasing.

    The rest is at most one copy of each basic pattern, so its size depends on ``capacity`` and not on the corpus.
    """
    demand = {n: k for n, k in demand.items() if k}
    if not demand:
        return []
    left, out = dict(demand), []
    for pattern, amount in zip(*relaxed_patterns(demand, capacity, tolerance), strict=True):
        count = min([int(amount + 1e-6), *(left[n] // k for n, k in pattern.items())])
        if count:
            out.append((pattern, count))
            for n, k in pattern.items():
                left[n] -= count * k
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[dict[int, int]] = []
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            space = next((s for s in range(n, capacity) if by_space[s]), None)
            if space is None:
                bins.append({})
                at, space = len(bins) - 1, capacity
            else:
                at = by_space[space].pop()
            bins[at][n] = bins[at].get(n, 0) + 1
            by_space[space - n].append(at)
    return out + [(b, 1) for b in bins]


# --- assignment -----------------------------------------------------------------------------------------------------

def _slots(spark, patterns: list[tuple[dict[int, int], int]]) -> DataFrame:
    """Slots of each length, counted from 0 over all patterns: which ranks go to which pattern, and where in it."""
    rows, used, first = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            k, begin = pattern[n], used.get(n, 0)
            rows.append((n, begin, begin + k * count, first, k, offset))
            used[n] = begin + k * count
            offset += k * n
        first += count
    schema = "length long, slot_from long, slot_to long, first_sequence long, copies long, first_offset long"
    return spark.createDataFrame(rows, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, tolerance: float = 0.002, text: str = "text") -> DataFrame:
    """One row a piece: its document, place, length and checksum, and the sequence and offset it is packed at.

    Documents longer than ``capacity`` tokens are cut into full pieces and a rest; nothing else is cut. The histogram of
    piece lengths (at most ``capacity`` numbers) goes to the driver, where column generation makes patterns: a linear
    program over patterns of lengths, new patterns priced by a knapsack. Rounded patterns are laid out as slots, and the
    pieces of each length, ranked by document, take the slots in order. The slot table is the only broadcast; it has at
    most some thousand rows, whatever the corpus.

    Null and empty texts are documents of the one token ``end_id``; rows with a null id and repeated rows are packed like any
    other; an empty table gives no rows. Equal lengths are ranked in ``SALTS`` parts, so a length that a third of the pieces
    share does not meet in one task. Sequence ids count from 0 without gaps.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, vocabulary, capacity, end_id, text), "pieces")
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")
    pieces = pieces.withColumn("part", part)
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(spark, integer_patterns(histogram, capacity, tolerance))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(parts), ["length", "part"])
    ranked = ranked.withColumn("slot", F.col("before") + F.col("rank"))
    placed = ranked.join(F.broadcast(slots), "length").where("slot >= slot_from and slot < slot_to")
    place = F.col("slot") - F.col("slot_from")
    return placed.select(
        *PIECES.names,
        (F.col("first_sequence") + F.floor(place / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(place, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
