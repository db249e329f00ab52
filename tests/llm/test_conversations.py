"""The conversation trie against plain loops, whole and cut into small blocks."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfgrid.llm.prefix_trie import RESULT, RangeMin, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed=5, n=80):
    """Shared openings, one common conversation, gaps in the ids, nulls, an empty text, a long conversation."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 11 == 7:
            continue  # some families have no first conversation
        length = 120 if c == 31 else rng.randrange(1, 7)
        for t in range(length):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"say {rng.randrange(3)}" if t < 4 else f"ü{c}-{t}"))
    for c in range(200, 240):
        rows += [(c, 0, "user", "hi"), (c, 1, "assistant", "höflich")]
    for c in range(300, 310):
        rows += [(c, None, None, None), (c, 0, "user", ""), (c, 5, "user", "x" * 3000)]
    rows += [(None, 0, "user", "lost"), (400, 0, "user", "hi"), (400, 1, "user", "same"), (400, 1, "user", "same")]
    return rows


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append((c, d == len(whole)))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c, last in sorted(members) if last)
        up = min(nodes[p[:-1]])[0] if p else None
        out.append((min(members)[0], len(p), up, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.select(*RESULT).collect()), key=str)


def test_trie(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "depth": F.lit(7), "key": F.lit(None).cast("string")})
    expected = brute(rows)
    assert result(prefix_trie(frame)) == expected
    for block_rows in (1, 7):  # most prefixes then reach over several blocks
        assert result(prefix_trie(frame, block_rows=block_rows)) == expected
    assert prefix_trie(frame.limit(0)).count() == 0


def test_turnless(spark):
    """Without own turns behind the heads and without a first conversation nothing but the root is left."""
    alone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:3]
    frame = spark.createDataFrame([(c, 0, "user", "a") for c in alone], SCHEMA)
    digest = hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()
    assert result(prefix_trie(frame, block_rows=2)) == [(alone[0], 0, None, 3, 0, 1, 0, digest)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(0, 4))
def test_extents(values, least):
    table = RangeMin(np.array(values))
    starts = np.arange(len(values))
    for i, (a, b) in enumerate(zip(table.left(starts, np.full(len(values), least)), table.right(starts, np.full(len(values), least)))):
        low, high = i, i
        while low > 0 and values[low] >= least:
            low -= 1
        while high + 1 < len(values) and values[high + 1] >= least:
            high += 1
        assert (a, b) == (low, high)
        assert table.least(np.array([a]), np.array([b]))[0] == min(values[a : b + 1])
