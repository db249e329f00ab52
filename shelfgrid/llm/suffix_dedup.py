"""Removal of byte strings that occur more than once, by a blockwise suffix array over a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgrid.llm.common import dropped, few_window_digests, released, text_or_empty, window_digests, written

#: A perfect difference cover. Every difference modulo PERIOD is that of two members.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
_CHUNK = 1 << 21  # bytes of text that a task works on at a time; longer texts are cut into overlapping segments
_BUCKET = 1 << 23  # bytes of text for each suffix bucket
_TURNS = 3  # the second round sorts so many shares of its buckets one after the other, so a share of its suffixes is on disk

_SENT = "kind int, bucket long, uid binary, a binary, b binary, c binary"
_FOUND = "kind int, uid binary, a binary, b binary, c binary"


# --- runs and gaps --------------------------------------------------------------------------------------------------

def _runs(positions: np.ndarray) -> np.ndarray:
    """Sorted distinct positions as rows (first, end)."""
    if not len(positions):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(positions) != 1)
    return np.column_stack([positions[np.append(0, cut + 1)], positions[np.append(cut, len(positions) - 1)] + 1])


def _cover_places(offset: int, n: int) -> np.ndarray:
    """The cover's places among the ``n`` from ``offset`` on, counted from there."""
    out = (np.arange(-(offset % PERIOD), n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return out[(out >= 0) & (out < n)]


def _covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(runs[:, 0], 0, n), 1)
    np.add.at(edge, np.clip(runs[:, 1], 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _whole(data: np.ndarray, gone: np.ndarray) -> bytes:
    """The UTF-8 characters of which no byte is gone."""
    if not gone.any():
        return data.tobytes()
    character = np.cumsum((data & 0xC0) != 0x80)
    return data[np.bincount(character, gone)[character] == 0].tobytes()


def _stored(positions: np.ndarray) -> bytes:
    """Rising positions as runs, or as the first one, minus the width and a bit for each place, whichever is shorter."""
    runs, width = _runs(positions), int(positions[-1] - positions[0]) + 1
    if len(runs) * 128 <= 128 + width:
        return runs.astype("<i8").tobytes()
    return np.array([positions[0], -width], "<i8").tobytes() + np.packbits(np.bincount(positions - positions[0]).astype(bool)).tobytes()


def _read_stored(stored: bytes) -> np.ndarray:
    first, width = np.frombuffer(stored, "<i8", count=2)
    if width >= 0:  # the end of a run
        return np.frombuffer(stored, "<i8").reshape(-1, 2)
    return _runs(np.flatnonzero(np.unpackbits(np.frombuffer(stored, np.uint8, offset=16), count=-width)) + first)


def _read_runs(stored: list[bytes] | None) -> np.ndarray:
    return np.concatenate([_read_stored(s) for s in stored]) if stored else np.zeros((0, 2), np.int64)


def _gaps(positions: np.ndarray) -> bytes:
    """Rising positions as differences in as few bytes as the largest needs, which the first byte says."""
    step = np.diff(positions, prepend=0)
    for kind in ("<u1", "<u2", "<u4"):
        if step.max(initial=0) <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + step.astype(kind).tobytes()
    raise ValueError("a chunk is below 4 GB")


def _ungaps(stored: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(stored, f"<u{stored[0]}", offset=1), dtype=np.int64)


# --- from texts to buckets ------------------------------------------------------------------------------------------

class _Chunk:
    """Segments of texts laid end to end: for each, its key, its first byte in its text and the text's length."""

    def __init__(self):
        self.pieces, self.keys, self.offsets, self.sizes, self.extra, self.total = [], [], [], [], [], 0

    def add(self, key: bytes, data: np.ndarray, offset: int, size: int, extra) -> None:
        self.pieces.append(data)
        self.keys.append(key)
        self.offsets.append(offset)
        self.sizes.append(size)
        self.extra.append(extra)
        self.total += len(data)


def _chunked(batches: Iterator[pa.RecordBatch], width: int, extra: Callable) -> Iterator[_Chunk]:
    """Chunks of about ``_CHUNK`` bytes; a segment holds ``width - 1`` bytes more than the windows that begin in it need."""
    chunk = _Chunk()
    for batch in batches:
        keys, texts = batch.column("key").to_pylist(), batch.column("data")
        for i, key in enumerate(keys):
            data = np.frombuffer(texts[i].as_buffer(), np.uint8) if texts[i].is_valid else np.zeros(0, np.uint8)
            if len(data) < width:
                continue
            more = extra(batch, i)
            for offset in range(0, len(data) - width + 1, _CHUNK):
                chunk.add(key, data[offset:offset + _CHUNK + width - 1], offset, len(data), more)
                if chunk.total >= _CHUNK:
                    yield chunk
                    chunk = _Chunk()
    if chunk.pieces:
        yield chunk


def _packed(digests: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each digest; the bucket says the rest where they do not hold all bits."""
    return np.ascontiguousarray(digests.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _sent(
    chunk: _Chunk, digests: np.ndarray, places: np.ndarray, silent: np.ndarray, bits: int, width: int, turn: int = 0, turns: int = 1
) -> Iterator[dict]:
    """Rows for the buckets of one turn. Equal suffixes of a chunk are folded: known to be repeated, they need no answer."""
    shift = np.uint64(64 - bits)
    if turns > 1:
        now = (digests >> shift) * np.uint64(turns) >> np.uint64(bits) == turn  # a stretch of buckets: sorted digests stay together
        digests, places, silent = digests[now], places[now], silent[now]
        if not len(digests):
            return
    starts = np.cumsum([0, *(len(p) for p in chunk.pieces)])[:-1]
    order = np.argsort(digests)
    d = digests[order]
    first = np.append(True, d[1:] != d[:-1])
    group = np.cumsum(first) - 1
    several = np.bincount(group) > 1
    quiet = np.bincount(group, silent[order]) > 0
    settled = several | quiet
    known = np.sort(places[order][several[group] & ~silent[order]])
    table = b"".join(chunk.keys)
    place_table = np.column_stack([starts, chunk.offsets]).astype("<i8").tobytes()
    uid = hashlib.sha256(table + place_table).digest()[:16]
    yield {"kind": 1, "bucket": int.from_bytes(uid[:6], "little") % (1 << bits), "uid": uid, "a": table, "b": place_table, "c": known.astype("<u4").tobytes()}
    told, open_ = d[first][settled], np.zeros(len(digests), bool)
    open_[order] = ~settled[group]
    asked, where = digests[open_], places[open_]
    bucket = (asked >> shift).astype(np.uint16 if bits <= 16 else np.uint64)
    by = np.argsort(bucket, kind="stable")  # places are rising, and stay so within a bucket
    asked, where = asked[by], where[by]
    buckets = np.arange((1 << bits) + 1, dtype=np.uint64)
    asked_at, told_at = np.searchsorted(bucket[by], buckets), np.searchsorted(told >> shift, buckets)
    for b in np.flatnonzero((np.diff(asked_at) > 0) | (np.diff(told_at) > 0)):
        lo, hi = asked_at[b], asked_at[b + 1]
        yield {
            "kind": 0, "bucket": int(b), "uid": uid, "a": _packed(asked[lo:hi], width), "b": _gaps(where[lo:hi]),
            "c": _packed(told[told_at[b]:told_at[b + 1]], width),
        }


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


# --- buckets --------------------------------------------------------------------------------------------------------

def _sorted_bucket(width: int):
    """Sort one bucket; each chunk hears which of its suffixes have an equal neighbour."""

    def work(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["kind"] == 1:
            return pa.Table.from_batches([_batch(rows, _FOUND)])
        suffixes = [_unpacked(r["a"], width) for r in rows]
        all_, told = np.concatenate(suffixes), np.unique(np.concatenate([_unpacked(r["c"], width) for r in rows]))
        if not len(all_):
            return pa.Table.from_batches([_batch([], _FOUND)])
        order = np.argsort(all_)
        s = all_[order]
        equal = s[1:] == s[:-1]
        tied = np.append(False, equal) | np.append(equal, False)
        if len(told):
            at = np.minimum(np.searchsorted(told, s), len(told) - 1)
            tied |= told[at] == s
        found = np.zeros(len(all_), bool)
        found[order] = tied
        out, at = [], 0
        for r, own in zip(rows, suffixes, strict=True):
            mine = found[at:at + len(own)]
            at += len(own)
            if mine.any():
                out.append({"kind": 0, "uid": r["uid"], "a": _ungaps(r["b"])[mine].astype("<u4").tobytes(), "b": None, "c": None})
        return pa.Table.from_batches([_batch(out, _FOUND)])

    return work


def _answers(group: pa.Table) -> pa.Table:
    """Repeated suffixes of one chunk, text by text."""
    rows = group.to_pylist()
    table = next(r for r in rows if r["kind"] == 1)
    places = np.unique(np.concatenate([np.frombuffer(r["c"] if r["kind"] == 1 else r["a"], "<u4") for r in rows])).astype(np.int64)
    starts, offsets = np.frombuffer(table["b"], "<i8").reshape(-1, 2).T
    piece = np.searchsorted(starts, places, "right") - 1
    own = places - starts[piece] + offsets[piece]
    cut = np.flatnonzero(np.diff(piece)) + 1
    out = [
        (table["a"][32 * piece[part[0]]:32 * piece[part[0]] + 32], _stored(own[part]))
        for part in np.split(np.arange(len(places)), cut) if len(part)
    ]
    return pa.table({"key": pa.array([k for k, _ in out], pa.binary()), "runs": pa.array([r for _, r in out], pa.binary())})


def _repeated(sent: DataFrame, width: int, name: str) -> DataFrame:
    found = sent.groupBy("kind", "bucket").applyInArrow(_sorted_bucket(width), _FOUND)
    answers = found.groupBy("uid").applyInArrow(_answers, "key binary, runs binary")
    out = written(answers.groupBy("key").agg(F.collect_set("runs").alias("runs")), name)
    released(sent.sparkSession)
    return out


# --- the operator ---------------------------------------------------------------------------------------------------

def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` without the text, with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    Texts are UTF-8 bytes, null is empty. A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
    else in the corpus, overlapping occurrences in the same text included; strings are judged on the input. ``n_spans``
    counts the maximal removed runs. With ``keep_text`` the last column ``kept`` holds the remaining bytes, without
    those of characters that a cut goes through. Repeated rows are
    copies of each other, so all their bytes go (if there are ``length``); an empty table gives no rows. Columns named like a
    new one are replaced.

    Two rounds of the same work. First the suffixes at the places of a difference cover are sorted by their first 64 bytes;
    two equal strings of 200 bytes always have a pair of cover places at the same distance from their starts, so only suffixes
    that begin at most ``PERIOD - 1`` bytes before a cover place of which those 64 bytes recur can be repeated. So the cover is
    a filter of candidates; no ranks are made, and it settles no tie. Then those suffixes are sorted by their first ``length`` bytes,
    which settles all ties. Sorting is by bucket, one bucket of bounded size in memory
    at a time; the second round takes its buckets in ``_TURNS`` turns, so that only a share of its suffixes is on disk at once. The order is that of 64-bit digests of the bytes, not the alphabet's: only ties count here. The first round
    keeps 32 bits beside the bucket, as it need not be exact; the second all 64, less those that the bucket says (two different strings are taken for one
    with a chance of 2**-64 a pair).

    Equal suffixes of a task's chunk are folded before the shuffle, and copies of a text take part once, so a passage or a text
    that a third of the rows share loads no bucket. ``length`` must be 200 or more.
    """
    if length < PERIOD + 63:
        raise ValueError("length must be at least PERIOD + 63")
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "key", "_data")
    data = text_or_empty(text).cast("binary")
    keyed = docs.withColumn("key", F.unhex(F.sha2(data, 256))).withColumn("_data", data)
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0
    bits = max(2, (total // _BUCKET).bit_length())

    def sampled(batches):
        for chunk in _chunked(batches, length, lambda *_: None):
            places, start = [], 0
            for piece, offset, size in zip(chunk.pieces, chunk.offsets, chunk.sizes, strict=True):
                # a segment answers for the places that begin in it; the last one for all up to the end
                end = min(len(piece), _CHUNK) if offset + len(piece) < size else len(piece)
                places.append(_cover_places(offset, min(end, len(piece) - 63)) + start)
                start += len(piece)
            at = np.concatenate(places)
            digests = few_window_digests(np.concatenate(chunk.pieces), at, 64)
            rows = list(_sent(chunk, digests, at, np.zeros(len(at), bool), bits, 4))
            yield _batch(rows, _SENT)

    shared = _repeated(keyed.select("key", F.col("_data").alias("data")).mapInArrow(sampled, _SENT), 4, "cover-repeats")
    texts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("_data").alias("data"))
    texts = written(texts.join(shared, "key"), "repeat-candidates")
    dropped(spark, shared)
    released(spark)
    whole = -(-(64 - bits) // 8)  # bytes that hold all bits of a digest but those of its bucket

    def candidates(batch, i):
        return batch.column("copies")[i].as_py(), _read_runs(batch.column("runs")[i].as_py())

    def suffixes(turn: int, batches):
        for chunk in _chunked(batches, length, candidates):
            places, silent, start = [], [], 0
            for piece, offset, (copies, runs) in zip(chunk.pieces, chunk.offsets, chunk.extra, strict=True):
                n = min(len(piece) - length + 1, _CHUNK)
                near = _covered(n, np.column_stack([runs[:, 0] - offset - PERIOD + 1, runs[:, 1] - offset]))
                places.append(np.flatnonzero(near) + start)
                silent.append(np.full(len(places[-1]), copies > 1))
                start += len(piece)
            at = np.concatenate(places)
            if not len(at):
                continue
            digests = window_digests(np.concatenate(chunk.pieces), at, length)
            yield _batch(list(_sent(chunk, digests, at, np.concatenate(silent), bits, whole, turn, _TURNS)), _SENT)

    turns = [_repeated(texts.mapInArrow(partial(suffixes, turn), _SENT), whole, "repeated-suffixes") for turn in range(_TURNS)]
    repeated = reduce(DataFrame.unionByName, turns).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def cut(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data, gone = np.frombuffer(r["data"], np.uint8), np.zeros(0, bool)
                if r["copies"] > 1 and len(data) >= length:
                    gone = np.ones(len(data), bool)
                else:
                    runs = _read_runs(r["repeats"])
                    gone = _covered(len(data), np.column_stack([runs[:, 0], runs[:, 1] + length - 1]))
                rest = data[~gone].tobytes()
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((r["key"], int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), _whole(data, gone) if keep_text else None))
            names = ["key", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    marked = texts.select("key", "copies", "data").join(repeated.withColumnRenamed("runs", "repeats"), "key", "left")
    judged = written(
        marked.mapInArrow(cut, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary").where("n_removed > 0"), "judged"
    )
    dropped(spark, texts, *turns)
    zero = F.lit(0).cast("long")
    base = keyed.withColumn("n_bytes", F.octet_length("_data").cast("long")).drop(text)
    if not keep_text:
        base = base.drop("_data")
    out = base.join(judged, "key", "left")
    found = [
        "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256"),
    ]
    if keep_text:
        found.append(F.coalesce("kept", "_data").alias("kept"))
    return out.select(*[c for c in docs.columns if c != text], *found)
