"""Trie of rebuilt conversations: every shared prefix with its members, from sorted longest common prefixes.

Conversations are sorted by the digests of their turns, so the members of a prefix are an interval of that order. The
order is dealt out in blocks. In a block a sparse table over the common prefixes of neighbours answers range minima, and
each candidate prefix finds its left and its right extent by its own binary search. Prefixes that reach over the edge of
a block give one part a block, and the parts are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.llm.common import dropped, text_or_empty, written

_WIDTH = 16  # bytes of a turn's digest
_NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = (
    "block int, open boolean, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends array<string>"
)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, key, sizes): each conversation begins with turns of the first one of its family of ``family`` ids.

    ``key`` chains 16-byte digests of (role, text), ``sizes`` holds the UTF-8 bytes of the texts. The first
    crc32(conv_id) % ``heads`` turns come from the family's first conversation (all it has, if fewer).
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"))
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("size"))
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own"))
    first = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("first"), F.slice("own", 1, heads - 1).alias("base")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h).join(first, "first", "left")
    base = F.when(F.col("base").isNotNull(), F.slice("base", 1, F.col("h"))).otherwise(F.slice("own", 1, 0))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    both = joined.select("conv_id", F.concat(base, rest).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return both.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


class RangeMin:
    """Sparse table of minima over ranges whose lengths are powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of [first, last] for each pair."""
        k = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.levels[level]
            out[at] = np.minimum(row[first[at]], row[last[at] + 1 - (1 << int(level))])
        return out

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each start the last place up to which all values behind it are at least ``least``."""
        place, n = start.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = place + (1 << k) < n
            fits[fits] = self.levels[k][place[fits] + 1] >= least[fits]
            place[fits] += 1 << k
        return place

    def left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each start the first place from which all values up to it, that place's own left out, are at least ``least``."""
        place = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = place - (1 << k) >= 0
            fits[fits] = self.levels[k][place[fits] + 1 - (1 << k)] >= least[fits]
            place[fits] -= 1 << k
        return place


def common_turns(a: bytes, b: bytes) -> int:
    shorter = min(len(a), len(b)) // _WIDTH
    if a[: shorter * _WIDTH] == b[: shorter * _WIDTH]:
        return shorter
    low, high = 0, shorter - 1  # the first `low` turns are equal, those after `high` are not all
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * _WIDTH] == b[: middle * _WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def _prefix_id(key: bytes, depth: int) -> bytes:
    return hashlib.md5(depth.to_bytes(8, "little") + key[: depth * _WIDTH]).digest()


def block_nodes(block: int, convs: np.ndarray, keys: list[bytes], sizes: list, before: bytes | None, after: bytes | None) -> dict:
    """Nodes with a member in a sorted block; ``before`` and ``after`` are the keys next to the block, if there are any."""
    n = len(convs)
    lengths = np.array([len(k) // _WIDTH for k in keys], dtype=np.int64)
    common = np.full(n + 1, -1, dtype=np.int64)  # common[i]: turns that row i shares with the row before it
    common[1:n] = [common_turns(a, b) for a, b in zip(keys, keys[1:])]
    if before is not None:
        common[0] = common_turns(before, keys[0])
    if after is not None:
        common[n] = common_turns(keys[-1], after)

    offsets = np.concatenate(([0], np.cumsum(lengths)))
    summed = np.concatenate(([0], np.cumsum(np.concatenate([np.asarray(s, dtype=np.int64) for s in sizes] + [np.zeros(0, np.int64)]))))

    def prefix_bytes(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return summed[offsets[row] + np.maximum(depth, 0)] - summed[offsets[row]]

    rows = np.arange(n)
    begins = common[:n] + 1  # the first depth at which a row starts a node of its own
    begins[0] = 0
    counts = lengths - begins + 1
    heads = np.concatenate(([0], np.cumsum(counts)))  # candidates of row i are heads[i] .. heads[i+1]-1, by depth
    row = np.repeat(rows, counts)
    depth = np.arange(heads[-1]) - heads[row] + begins[row]

    table = RangeMin(np.concatenate(([np.int64(2**62)], common[1:n])))
    left, right = table.left(row, depth), table.right(row, depth)
    open_left = (left == 0) & (common[0] >= depth)
    is_open = open_left | ((right == n - 1) & (common[n] >= depth))

    # A child's parent is the node one turn shorter that covers the same row.
    above = table.left(row, np.maximum(depth - 1, 0))
    parent = np.where(depth > 0, heads[above] + depth - 1 - begins[above], -1)
    started = (depth > 0) & ~open_left
    children = np.bincount(parent[started], minlength=len(row))

    leaf_ends = np.concatenate(([0], np.cumsum(common[1:] < lengths)))
    shared = np.where(common[:n] >= 0, prefix_bytes(rows, common[:n]), 0)
    shared_sum = np.concatenate(([0], np.cumsum(shared)))
    follows = right - left + open_left
    saved = shared_sum[right + 1] - shared_sum[left + 1] + np.where(open_left, shared[0], 0) - follows * prefix_bytes(row, depth - 1)

    same = RangeMin(np.where(np.concatenate(([False], (common[1:n] == lengths[1:]) & (lengths[1:] == lengths[:-1]))), 1, 0))
    run_end = same.right(rows, np.ones(n, dtype=np.int64))
    smallest = RangeMin(convs).least(left, right)

    out = {name: [] for name in ("id", "parent_id", "ends_sha256", "ends")}
    for k in range(len(row)):
        i, d, up = int(row[k]), int(depth[k]), int(parent[k])
        members = convs[i : run_end[i] + 1].tolist() if lengths[i] == d else []
        out["id"].append(_prefix_id(keys[i], d) if is_open[k] else None)
        out["parent_id"].append(_prefix_id(keys[i], d - 1) if up >= 0 and is_open[up] else None)
        if is_open[k]:
            out["ends_sha256"].append(None)
            out["ends"].append([",".join(map(str, members[s : s + 1024])) for s in range(0, len(members), 1024)] or None)
        else:
            joined = ",".join(map(str, members))
            out["ends_sha256"].append(hashlib.sha256(joined.encode()).hexdigest() if members else _NOTHING)
            out["ends"].append(None)
    known = (parent >= 0) & ~is_open[parent]
    return {
        "block": np.full(len(row), block, dtype=np.int32), "open": is_open, **{k: out[k] for k in ("id", "parent_id")},
        "conv_id": smallest, "depth": depth, "parent_conv_id": pa.array(smallest[parent], mask=~known),
        "n_convs": right - left + 1, "n_children": children, "n_leaves": leaf_ends[right + 1] - leaf_ends[left],
        "saved_tokens": saved, **{k: out[k] for k in ("ends_sha256", "ends")},
    }


def _block_table(members: pa.Table, edge: pa.Table) -> pa.Table:
    members = members.sort_by([("key", "ascending"), ("conv_id", "ascending")])
    block, before, after = (edge.column(c)[0].as_py() for c in ("block", "before", "after"))
    nodes = block_nodes(
        block, members.column("conv_id").to_numpy(), members.column("key").to_pylist(), members.column("sizes").to_pylist(), before, after
    )
    types = {"id": pa.binary(), "parent_id": pa.binary(), "ends_sha256": pa.string(), "ends": pa.list_(pa.string())}
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, types.get(k)) for k, v in nodes.items()})


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest an id over its chunks, which come in order; the state is one running digest."""
    now, state = None, None
    for batch in batches:
        ids, digests = [], []
        for id_, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if id_ != now:
                if now is not None:
                    ids.append(now)
                    digests.append(state.hexdigest())
                now, state = id_, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        yield pa.record_batch({"id": pa.array(ids, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
    if now is not None:
        yield pa.record_batch({"id": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def prefix_trie(turns: DataFrame, block_rows: int = 32_768, family: int = 5, heads: int = 9) -> DataFrame:
    """One row a node of the trie of rebuilt conversations, with the columns of ``RESULT``.

    A node is a distinct sequence of the first ``depth`` turns; its members are the conversations that begin with it.
    Null roles and texts are empty, null turns come first, equal turns follow their digest, rows without a ``conv_id``
    belong to no conversation and repeated rows are turns of their own. An empty table has no nodes. Columns other than
    conv_id, turn, role and text are not read.

    A task holds the digests of ``block_rows`` conversations (24 bytes a turn), so one conversation must fit a task.
    A prefix that all share is a part of one row in each block. Turns are equal if 128-bit digests are.
    """
    spark = turns.sparkSession
    whole = written(rebuilt(turns.select("conv_id", "turn", "role", "text"), family, heads), "conversations")
    blocks = max(1, -(-whole.count() // block_rows))
    dealt = whole.repartitionByRange(blocks, "key", "conv_id").withColumn("block", F.spark_partition_id())
    dealt = written(dealt, "sorted-conversations")
    edges = dealt.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    in_order = Window.orderBy("block")  # one row a block
    edges = edges.select("block", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after"))
    nodes = dealt.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_block_table, _NODE)
    nodes = written(nodes, "prefix-nodes")
    dropped(spark, whole)

    parts = nodes.where("open")
    chunks = parts.select("id", "block", F.posexplode("ends").alias("at", "chunk"))
    chunks = chunks.repartition("id").sortWithinPartitions("id", "block", "at").select("id", "chunk")
    digests = chunks.mapInArrow(_digested, "id binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("id").agg(F.min("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums)
    above = merged.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("above"))
    merged = merged.join(above, "parent_id", "left").withColumnRenamed("above", "parent_conv_id").join(digests, "id", "left")
    merged = merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))

    whole_nodes = nodes.where("not open")
    # Parents that reach over blocks are looked up by block, so that the children of one prefix stay spread.
    named = parts.select("block", F.col("id").alias("parent_id")).join(above, "parent_id")
    below = whole_nodes.where("parent_id is not null").drop("parent_conv_id").join(named, ["block", "parent_id"])
    below = below.withColumnRenamed("above", "parent_conv_id")
    columns = [F.col(c) for c in RESULT]
    return whole_nodes.where("parent_id is null").select(columns).unionByName(below.select(columns)).unionByName(merged.select(columns))
