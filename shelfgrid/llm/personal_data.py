"""Personal data in texts: fixed patterns, and spans that a character tagger learned from them finds in other spellings.

The patterns are read in linear time whatever the text. The tagger (a bidirectional LSTM under a chain of tags) learns
from the patterns' spans, also rewritten with other separators, among look-alikes. It reads overlapping windows; the
spans of all windows of a text are reconciled at once. Nothing that the patterns found is taken back.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfgrid.llm.char_tagger import best_tags, dumped, emissions, encoded, fitted, loaded
from shelfgrid.llm.common import dropped, written

KINDS = ("email", "ip", "card", "phone")
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
WINDOW, STRIDE = 160, 96
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive forms of the contract's patterns: the same leftmost matches, as a match that starts at the first digit of
# a run takes the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Every kind needs a digit or an at sign, so the tagger reads the windows that have one.
_SIGN = re.compile("[0-9@]")

Span = tuple[int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (doubled + sum(int(c) for c in digits[-1::-2])) % 10 == 0


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at)):
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the fixed patterns of each kind, leftmost and without overlaps in a kind; failing matches are dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if _is_ip(m.group().split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(_digits(m.group()))]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def plausible(kind: str, text: str) -> bool:
    """What a span of a kind has in any spelling: the checks of the patterns, whatever stands between the parts."""
    digits = _digits(text)
    if kind == "email":
        return re.search(r"[A-Za-z0-9]\s*@\s*[A-Za-z0-9-]+\s*\.\s*[A-Za-z0-9]", text) is not None
    if kind == "ip":
        return _is_ip(re.findall("[0-9]+", text))
    if kind == "card":
        return _is_card(digits)
    return 9 <= len(digits) <= 15 and len(digits) < len(text)


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a sign of personal data; every such place is in a window."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    starts: list[int] = []
    for found in _SIGN.finditer(text):
        at = found.start()
        for k in range(max(0, -(-(at - WINDOW + 1) // STRIDE)), min(last, at // STRIDE) + 1):
            if not starts or k * STRIDE > starts[-1]:
                starts.append(k * STRIDE)
    return starts


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces, begins, ends, kinds = [], [], [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            spans = sorted((s, e, k) for k, found in enumerate(base_spans(text).values()) for s, e in found)
            stops = [e for _, e, _ in spans]
            for start in windows_of(text):
                inside = [(max(s - start, 0), min(e - start, WINDOW), k) for s, e, k in spans[bisect_right(stops, start) :] if s < start + WINDOW]
                pieces.append(text[start : start + WINDOW])
                for into, values in zip((begins, ends, kinds), zip(*inside) if inside else ((), (), ())):
                    into.append(list(values))
        lists = (pa.array(x, pa.list_(pa.int32())) for x in (begins, ends, kinds))
        yield pa.record_batch([pa.array(pieces, pa.string()), *lists], names=["piece", "begins", "ends", "kinds"])


def _number(rng: np.random.Generator, length: int) -> str:
    return "".join(map(str, rng.integers(0, 10, length)))


def _rewritten(rng: np.random.Generator, kind: int, text: str) -> str:
    """The same datum with other separators, which the patterns miss for the most part."""
    if KINDS[kind] == "email":
        return text.replace("@", str(rng.choice([" @ ", "@ ", " @"])))
    if KINDS[kind] == "ip":
        return text.replace(".", str(rng.choice([" . ", ". ", "-", ":"])))
    digits = _digits(text)
    if KINDS[kind] == "card":
        gap = str(rng.choice([" ", "-", ".", "/", "  "]))
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    shape = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "00" + digits[:-10] + " {} {} {}", "1-{}-{}-{}"])
    return str(shape).format(local[:3], local[3:6], local[6:])


def _look_alike(rng: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    shapes = (
        lambda: _number(rng, int(rng.integers(1, 13))), lambda: f"20{_number(rng, 2)}-0{rng.integers(1, 10)}-1{rng.integers(0, 10)}",
        lambda: f"{rng.integers(0, 24)}:{rng.integers(10, 60)}", lambda: f"{rng.integers(1, 99)}.{_number(rng, 2)}",
        lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 9)}", lambda: rng.bytes(int(rng.integers(4, 17))).hex(),
        lambda: f"@{'abcdefgh'[: int(rng.integers(2, 9))]}", lambda: f"#{_number(rng, 5)}", lambda: f"id={_number(rng, 16)[:16]}x",
    )
    return shapes[int(rng.integers(len(shapes)))]()


def training_windows(rows: list[tuple[str, list[int], list[int], list[int]]], length: int = 96, seed: int = 11):
    """(chars, tags) of windows made of labelled pieces: as they are, with rewritten spans, and with look-alikes."""
    rng, chars, tags = np.random.default_rng(seed), [], []
    for piece, begins, ends, kinds in rows:
        for variant in range(3 if kinds else 2):
            text, marks, last = "", [], 0
            for s, e, k in sorted(zip(begins, ends, kinds)):
                if s < last:
                    continue  # inside the span before it
                text += piece[last:s]
                whole = s > 0 and e < len(piece)
                new = _rewritten(rng, k, piece[s:e]) if variant and whole and rng.random() < 0.7 else piece[s:e]
                marks.append((len(text), len(text) + len(new), k))
                text, last = text + new, e
            text += piece[last:]
            gaps = [i for i, c in enumerate(text) if c == " " and not any(s <= i < e for s, e, _ in marks)]
            if variant and gaps and (not marks or rng.random() < 0.5):
                at = int(rng.choice(gaps))
                extra = " " + _look_alike(rng)
                text = text[:at] + extra + text[at:]
                marks = [(s + len(extra), e + len(extra), k) if s >= at else (s, e, k) for s, e, k in marks]
            near = marks[int(rng.integers(len(marks)))][0] if marks else int(rng.integers(max(len(text), 1)))
            start = max(0, min(near - int(rng.integers(0, length - 8)), len(text) - length))
            tag = np.zeros(len(text) + length, dtype=np.int64)
            for s, e, k in marks:
                tag[s], tag[s + 1 : e] = 1 + 2 * k, 2 + 2 * k
            chars.append(encoded(text[start : start + length], length))
            tags.append(tag[start : start + length])
    return np.array(chars), np.array(tags)


def train_tagger(docs: DataFrame, most: int = 700, steps: int = 300, hidden: int = 12) -> bytes | None:
    """Parameters of a tagger that learned from ``docs``, or None where no text has a span of the patterns.

    The training set is bounded: ``most`` windows with and ``most`` without a span, those of smallest hash of all.
    """
    found = docs.select("text").mapInArrow(_piece_rows, "piece string, begins array<int>, ends array<int>, kinds array<int>")
    found = written(found.withColumn("h", F.xxhash64("piece", F.monotonically_increasing_id())), "labelled-windows")
    has = F.size("kinds") > 0
    drawn = found.where(has).orderBy("h").limit(most).unionByName(found.where(~has).orderBy("h").limit(most))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        rows = [r[:4] for r in sorted(rows, key=lambda r: (r[4], r[0]))]
        if any(kinds for *_, kinds in rows):
            chars, tags = training_windows(rows)
            yield pa.record_batch({"model": [dumped(fitted(chars, tags, len(KINDS), hidden, steps))]})

    models = drawn.coalesce(1).mapInArrow(train, "model binary").collect()
    dropped(docs.sparkSession, found)
    return bytes(models[0]["model"]) if models else None


#: (start, end, kind, score, cut on the left, cut on the right)
Found = tuple[int, int, int, float, bool, bool]


def window_spans(p: dict[str, np.ndarray], pieces: list[tuple[int, str, bool]]) -> list[list[Found]]:
    """Spans of each (start, piece, last of its text) in the best chain of tags, placed in the whole text."""
    chars = np.stack([encoded(piece, WINDOW) for _, piece, _ in pieces], axis=1)
    scores, _ = emissions(p, chars)
    tags = best_tags(p, scores)
    gains = np.take_along_axis(scores, tags[:, None, :], axis=1)[:, 0] - scores[:, 0]
    out: list[list[Found]] = [[] for _ in pieces]
    for column in np.flatnonzero((tags > 0).any(axis=0)):
        start, piece, last = pieces[column]
        own, at = tags[: len(piece), column], 0
        while at < len(own):
            if own[at] == 0:
                at += 1
                continue
            kind, end = (int(own[at]) - 1) // 2, at + 1
            while end < len(own) and own[end] == 2 + 2 * kind:
                end += 1
            gain = float(gains[at:end, column].sum())
            out[column].append((start + at, start + end, kind, gain, at == 0 and start > 0, end == len(own) and not last))
            at = end
    return out


def reconciled(text: str, found: list[Found], base: dict[str, list[Span]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the windows of one text add to the patterns' spans.

    Pieces of a kind that a window's edge cut are joined where they overlap. Of all sets of spans without overlaps the one
    of highest total score stays, over the whole text at once. What meets a span of the patterns or lacks what its kind
    has in any spelling goes.
    """
    joined: list[list] = []
    for s, e, kind, gain, left, right in sorted(found, key=lambda f: (f[2], f[0], f[1])):
        last = joined[-1] if joined else None
        if last and last[2] == kind and s < last[1] and (left or right or last[4] or last[5] or (s, e) == (last[0], last[1])):
            longest = e if e > last[1] else last[1]
            last[1:] = [longest, kind, max(last[3], gain), last[4] or left, right if e >= longest else last[5]]
        else:
            joined.append([s, e, kind, gain, left, right])
    spans = sorted(((s, e, kind, gain) for s, e, kind, gain, *_ in joined), key=lambda x: (x[1], x[0], x[2]))
    ends, best, before = [s[1] for s in spans], [0.0], []
    for k, (s, _, _, gain) in enumerate(spans):
        before.append(bisect_right(ends, s, 0, k))
        best.append(max(best[k], best[before[k]] + gain))
    kept, k = [], len(spans)
    while k:
        if best[k] > best[k - 1]:
            kept.append(spans[k - 1])
            k = before[k - 1]
        else:
            k -= 1
    taken = sorted(s for spans in base.values() for s in spans)
    reach, furthest = [], 0
    for _, e in taken:
        reach.append(furthest := max(furthest, e))
    starts, out = [s for s, _ in taken], []
    for s, e, kind, _ in kept:
        while s < e and not text[e - 1].isalnum():
            e -= 1
        while s < e and not (text[s].isalnum() or text[s] in "(+"):
            s += 1
        at = bisect_right(starts, e - 1)
        torn = _DIGIT.match(text, e) or s > 0 and _DIGIT.match(text, s - 1)  # a part of a longer number
        if s < e and not torn and not (at and reach[at - 1] > s) and plausible(KINDS[kind], text[s:e]):
            out.append((kind, s, e))
    return sorted(out)


def _scan(model: bytes | None, kept: list[str], chunk: int = 1024):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(model) if model else None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found: dict[int, list[Found]] = {}
            waiting: list[tuple[int, tuple[int, str, bool]]] = []

            def read() -> None:
                if waiting:
                    for (row, _), spans in zip(waiting, window_spans(p, [w for _, w in waiting])):
                        found.setdefault(row, []).extend(spans)
                    waiting.clear()

            if p:
                for row, text in enumerate(texts):
                    for start in windows_of(text):
                        waiting.append((row, (start, text[start : start + WINDOW], start + WINDOW >= len(text))))
                        if len(waiting) == chunk:
                            read()
                read()
            counts, digests, spans, added = {k: [] for k in KINDS}, [], [], []
            for row, text in enumerate(texts):
                base = base_spans(text)
                listed = [(k, s, e) for k, kind in enumerate(KINDS) for s, e in base[kind]]
                more = reconciled(text, found[row], base) if row in found else []
                said = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in part) for part in (listed, sorted(listed + more))]
                digests.append(hashlib.sha256(said[0].encode()).hexdigest())
                spans.append(said[1])
                added.append(len(more))
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
            columns = {c: batch.column(c) for c in kept} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
            columns |= {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()), "n_added": pa.array(added, pa.int64())}
            yield pa.record_batch(columns)

    return scan


def find_personal_data(docs: DataFrame, model: bytes | None) -> DataFrame:
    """Each row of ``docs`` without its text, with the columns of ``RESULT`` in place of columns of those names.

    ``n_email`` to ``n_phone`` count the patterns' spans, ``base_sha256`` is their digest (kind:start:end, by kind, then
    start; code points, end exclusive), ``spans`` lists them with the ``n_added`` ones of the tagger ``model`` (none
    without a model). Null texts are empty; empty texts have no spans; rows may repeat, and each is read whole.
    """
    result = StructType.fromDDL(RESULT)
    fields = [f for f in docs.schema if f.name != "text" and f.name not in result.names]
    return docs.mapInArrow(_scan(model, [f.name for f in fields]), StructType([*fields, *result]))
