"""Ranked search of documents for the terms of items, by lists of falling impact that are read only as far as needed.

Documents are dealt out in shards. A shard keeps, for each term that items ask for, its postings by falling impact, and
reads the lists of an item in step. What it has read bounds each document's score from below; what the lists still
promise bounds it from above. Reading ends when the best of the shard, their ties and their scores cannot change any
more (no random access). The best of the shards are merged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgrid.llm.common import lower_ascii, text_or_empty, written

#: Fixed value: what is not part of a term.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FILTER_BITS = 20
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: letters A-Z in lower case, digits and whatever is not ASCII."""
    return text.translate(_FOLDED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of the terms of all rows of an item."""
    found = F.regexp_extract_all(lower_ascii(text_or_empty()), F.lit(_TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _bit_filter(terms: DataFrame) -> np.ndarray:
    """2**20 bits that say which hashes the asked terms have: at most 16384 words, whatever the number of terms."""
    places = terms.select((F.crc32(F.col("term").cast("binary")) % (1 << _FILTER_BITS)).cast("int").alias("place"))
    words = places.select(F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, place % 64)").alias("bit"))
    out = np.zeros((1 << _FILTER_BITS) // 64, dtype=np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[word] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(place, doc_id, n, terms, times): the asked terms of each document that has any term, counted; ``n`` is all its terms.

    Terms that only share a hash with an asked one may be among them. ``place`` numbers the rows.
    """
    wanted = _bit_filter(terms)
    id_type = next(f.dataType.simpleString() for f in docs.schema if f.name == "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        for batch in batches:
            rows, totals, sizes, terms, times = [], [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                found = terms_of(text or b"")
                if not found:
                    continue
                before = len(terms)
                for term, n in Counter(found).items():
                    if (keep := known.get(term)) is None:
                        if len(known) > 500_000:
                            known.clear()
                        keep = known[term] = bool(wanted[zlib.crc32(term) & ((1 << _FILTER_BITS) - 1)])
                    if keep:
                        terms.append(term)
                        times.append(n)
                rows.append(row)
                totals.append(len(found))
                sizes.append(len(terms) - before)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "n": pa.array(totals, pa.int64()),
                "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())),
                "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
            })

    found = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {id_type}, n long, terms array<string>, times array<long>")
    return found.withColumn("place", F.monotonically_increasing_id())


class Shard:
    """Impact-ordered lists of the terms that a block of items asks for, over the documents of one shard."""

    def __init__(self, doc_of: np.ndarray, term_of: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort((term_of << 40) | ((1 << 40) - 1 - impact), kind="stable")
        self.docs, self.impacts, self.n_docs = doc_of[order], impact[order], n_docs
        self.starts = np.searchsorted(term_of[order], np.arange(n_terms + 1))
        # For each document the terms it was listed under and how deep in their lists: tells what has been read of it.
        by_doc = np.argsort(self.docs, kind="stable")
        self.doc_terms = term_of[order][by_doc]
        self.doc_depths = by_doc - self.starts[self.doc_terms]
        self.doc_starts = np.searchsorted(self.docs[by_doc], np.arange(n_docs + 1))
        self._read, self._next = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, entries read) of the ``k`` highest scores above 0, ties to the smaller document."""
        starts, ends = self.starts[terms], self.starts[terms + 1]
        at, lower, entries = starts.copy(), np.zeros(self.n_docs, dtype=np.int64), 0
        read, promised = self._read, self._next  # by term: entries read, and the most that an unread entry adds
        while True:
            for t in np.flatnonzero(at < ends):
                part = slice(at[t], min(at[t] + step, ends[t]))
                lower[self.docs[part]] += times[t] * self.impacts[part]
                entries += part.stop - part.start
                at[t] = part.stop
            step *= 2
            left = at < ends
            ahead = np.zeros(len(terms), dtype=np.int64)
            ahead[left] = times[left] * self.impacts[at[left]]
            total = ahead.sum()
            if not left.any():
                break
            threshold = np.partition(lower, self.n_docs - k)[self.n_docs - k] if self.n_docs >= k else 0
            if total >= threshold:  # a document that no list has shown so far could still come in
                continue
            read[terms], promised[terms] = at - starts, ahead
            open_docs = np.flatnonzero(lower + total >= threshold)
            missing = total - self._promised_and_read(open_docs)
            read[terms], promised[terms] = 0, 0
            if not ((missing > 0) & (lower[open_docs] + missing >= threshold)).any():
                break
        found = np.flatnonzero(lower > 0)
        if len(found) > k:
            scores = lower[found]
            cut = np.partition(scores, len(found) - k)[len(found) - k]
            found = found[scores >= cut]
        found = found[np.lexsort((found, -lower[found]))][:k]
        return found, lower[found], entries

    def _promised_and_read(self, docs: np.ndarray) -> np.ndarray:
        """Sum of what the item's lists still promise, over those lists in which each document has been read already."""
        first, last = self.doc_starts[docs], self.doc_starts[docs + 1]
        sizes = last - first
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - first, sizes)
        terms = self.doc_terms[at]
        value = np.where(self.doc_depths[at] < self._read[terms], self._next[terms], 0)
        summed = np.concatenate(([0], np.cumsum(value)))
        return summed[ends] - summed[ends - sizes]


def _shard_search(k: int):
    def search(docs: pa.Table, items: pa.Table) -> pa.Table:
        if not len(docs) or not len(items):
            return pa.table({"item_id": items.column("item_id")[:0], "doc_id": docs.column("doc_id")[:0], "score": pa.array([], pa.int64())})
        docs = docs.take(pc.sort_indices(docs, [("doc_id", "ascending")], null_placement="at_start"))
        lists, asked = docs.column("terms").combine_chunks(), items.column("terms").combine_chunks()
        words = pc.unique(asked.flatten())
        doc_of = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy(zero_copy_only=False))
        found = pc.index_in(lists.flatten(), value_set=words)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        term_of = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        doc_of, tf = doc_of[hit], docs.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)[hit]
        item_terms = pc.index_in(asked.flatten(), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        times = items.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        weights = np.zeros(len(words), dtype=np.int64)
        weights[item_terms] = items.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        share = (1_000_000_000 * tf) // (1000 * tf + 12 * docs.column("m").to_numpy()[doc_of])
        shard = Shard(doc_of, term_of, weights[term_of] * share, len(docs), len(words))
        ends = np.concatenate(([0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))))
        rows, best, scores = [], [], []
        for i in range(len(items)):
            own = slice(ends[i], ends[i + 1])
            found, score, _ = shard.best(item_terms[own], times[own], k)
            rows.append(np.full(len(found), i))
            best.append(found)
            scores.append(score)
        rows, best, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, best, scores))
        return pa.table({"item_id": items.column("item_id").take(rows), "doc_id": docs.column("doc_id").take(best), "score": scores})

    return search


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard_docs: int = 8192, block_items: int = 512) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, equal scores by ``doc_id``.

    Each row of ``docs`` (doc_id, text) is a document of its own, so a repeated row is ranked twice; rows of ``items``
    (item_id, text) that share an id are one item with the terms of all of them. Null and empty texts hold no term, match
    nothing and do not count; a null id is an id like any other and comes first among ties. An item without a match, and
    any item over an empty table, has no rows. Other columns are not read.

    A task holds ``shard_docs`` documents' asked terms and ``block_items`` items. Weights are computed over all documents.
    """
    asked = written(item_terms(items.select("item_id", "text")), "item-terms")
    found = written(postings(docs, asked.select("term")), "postings")
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    frequencies = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    weighed = asked.join(frequencies, "term").withColumn("weight", weight).where("weight > 0")
    entry = F.struct("term", "times", "weight")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // block_items))
    shards = max(1, -(-n_docs // shard_docs))
    by_item = weighed.groupBy("item_id").agg(F.collect_list(entry).alias("entries")).select(
        "item_id", F.col("entries.term").alias("terms"), F.col("entries.times").alias("times"), F.col("entries.weight").alias("weights"),
        F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), F.explode(_numbers(shards)).alias("shard"),
    )
    m = F.expr(f"100 - 25 + (25 * n * {n_docs}L) div {n_terms}L")
    dealt = found.select(
        "doc_id", m.alias("m"), "terms", "times", F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"),
        F.explode(_numbers(blocks)).alias("block"),
    )
    types = {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema] if f.name in ("doc_id", "item_id")}
    best = dealt.groupBy("shard", "block").cogroup(by_item.groupBy("shard", "block")).applyInArrow(
        _shard_search(k), f"item_id {types['item_id']}, doc_id {types['doc_id']}, score long"
    )
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
