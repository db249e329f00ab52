"""Toxicity scores after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgrid.llm.common import text_or_empty, written

#: Letters that a written character may stand for (besides itself).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou",
}
#: Marks that may be slipped between letters.
FILLERS = ".-_~'`"
_EDGE = "".join(c for c in "\"'`.,;:!?()[]{}<>|*-_~#%&=/\\")
#: Two or more written characters with blanks between them, each with a mark behind it or none.
_SPACED = re.compile(r"(?<!\S)(?:\S[.\-_*~'`,]?\s+)+\S[.\-_*~'`,]?(?!\S)")
_BLANK = re.compile(r"\s+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_ODD = re.compile(r"[0-9@$!|+€(*.\-_~'`]")
#: Memoised tokens are at most so long; longer ones are decoded each time.
_REMEMBERED = 200


class CharModel:
    """Interpolated trigram log-probabilities of letters; ``^`` stands before and ``$`` after a word."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.two: Counter = Counter()
        self.context: Counter = Counter()
        self.one: Counter = Counter()
        for gram, n in counts.items():
            self.two[gram[1:]] += n
            self.context[gram[:2]] += n
            self.one[gram[2]] += n
        self.before: Counter = Counter()
        for gram, n in self.two.items():
            self.before[gram[0]] += n
        self.total = sum(self.one.values())
        self.kinds = len(self.one) + 1
        self.known: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        found = self.known.get(gram)
        if found is None:
            one = (self.one[gram[2]] + 0.5) / (self.total + 0.5 * self.kinds)
            two = (self.two[gram[1:]] + 2 * one) / (self.before[gram[1]] + 2)
            three = (self.three.get(gram, 0) + 2 * two) / (self.context[gram[:2]] + 2)
            found = self.known[gram] = -math.log(three)
        return found


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal written characters, the letters it may restore to and the channel's cost of each.

    A blank among the letters is the boundary of two words. Gaps and marks may stand for one or for nothing, gaps wider
    than the narrowest one of the token rather for one.
    """
    out, at = [], 0
    narrow = min((len(m.group()) for m in _BLANK.finditer(token)), default=0)
    while at < len(token):
        char, end = token[at], at + 1
        if char.isspace():
            end = _BLANK.match(token, at).end()
            out.append([("", 0.2), (" ", 1.6)] if end - at == narrow else [("", 1.6), (" ", 0.2)])
            at = end
            continue
        while end < len(token) and token[end] == char:
            end += 1
        n = end - at
        if char.isalpha():
            options = [(char * min(n, 4), 0.0 if n < 3 else 6.0)] + ([(char, 0.5), (char * 2, 0.7)] if n > 2 else [])
        else:
            options = [(letter * k, 1.0) for letter in LEET.get(char, "") for k in {1, min(n, 2)}]
            if char in FILLERS:
                options += [("", 1.5), (" ", 2.0)]
            options.append((char * n, 5.0 * n))
        out.append(options)
        at = end
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest clear form of a written token, its words parted by blanks.

    Viterbi over the lattice, a state being the last two letters. A path is a chain of links, so the time is linear in
    the token's length.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for options in _lattice(token):
        following: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, said) in states.items():
            for letters, paid in options:
                total, last = cost + paid, state
                for letter in letters:
                    if letter != " ":
                        total += model.cost(last + letter)
                        last = last[1] + letter
                    elif last != "^^":
                        total += model.cost(last + "$")
                        last = "^^"
                if last not in following or total < following[last][0]:
                    following[last] = (total, (letters, said) if letters else said)
        states = following
    said = min(((cost + (model.cost(state + "$") if state != "^^" else 0), said) for state, (cost, said) in states.items()), key=lambda x: x[0])[1]
    parts = []
    while said is not None:
        letters, said = said
        parts.append(letters)
    return " ".join("".join(reversed(parts)).split())


def _core(word: str) -> str:
    """A written word without the marks around it and without one that is repeated at its end."""
    if word.isalpha():
        return word
    last = word[-1]
    if not (last.isalnum() or last == "_") and len(word) - len(cut := word.rstrip(last)) > 2:
        word = cut
    return word.strip(_EDGE)


def clear_words(text: str, model: CharModel, known: dict[str, str]) -> set[str]:
    """The distinct restored words of a text. Words with nothing odd in them stay as they are.

    Spaced-out characters are read with word boundaries where the model sees them, and also as one word and without the
    first or last of them.
    """
    text = text.lower()
    words = set(text.split())
    out, odd = set(), []
    for found in _SPACED.finditer(text):
        spaced = found.group()
        if any(c.isalpha() for c in spaced):
            inner = spaced.strip(_EDGE + " \t\r\n")
            parts = _BLANK.split(inner)
            # a one-letter word of the sentence may stand before or behind the spaced-out ones
            odd += [spaced, inner, "".join(parts), *((inner[len(parts[0]):].lstrip(), inner[:-len(parts[-1])].rstrip()) if len(parts) > 2 else ())]
    for word in words:
        core = _core(word)
        if not core:
            continue
        if _ODD.search(core) and any(c.isalpha() for c in core) or _RUN.search(core):
            odd.append(core)
        out.add(core)
    for core in odd:
        if (found := known.get(core)) is None:
            found = decode(core, model)
            if len(core) <= _REMEMBERED:
                if len(known) > 200_000:
                    known.clear()
                known[core] = found
        out.update(found.split())
    return out


def _features(words: set[str]) -> set[str]:
    return words | {w[:4] + "*" for w in words if len(w) > 4}


def fit_characters(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Letter trigrams of all words of all documents, each word weighing the logarithm of its count plus one.

    Word counts are pre-aggregated in each batch and summed by Spark. Letters outside the 64 commonest count as ``?``, so
    what reaches the driver has at most 66**3 entries.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0).to_pylist():
                seen.update(value.lower().split())
            kept = [(w, n) for w, n in seen.items() if len(w) < 40 and w.isalpha()]
            yield pa.record_batch([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    words = docs.select(text_or_empty(text).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "word-counts")
    weight = F.ceil(F.log2(F.col("n") + 1))
    letters = words.select(F.explode(F.split("word", "")).alias("c"), weight.alias("n")).where("c != ''").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = "".join(r["c"] for r in letters.orderBy(F.desc("n"), "c").limit(64).collect())
    plain = F.concat(F.lit("^^"), F.regexp_replace("word", f"[^{alphabet}]" if alphabet else ".", "?"), F.lit("$"))
    grams = words.select(plain.alias("w"), weight.alias("n")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("gram"), "n"
    )
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.sum("n").cast("long").alias("n")).collect()}


def fit_words(labelled: DataFrame, characters: dict[str, int], confidence: float = 2.0, most: int = 20_000) -> tuple[dict[str, tuple[int, int]], float]:
    """(toxic, clean) counts of telling restored words and word beginnings, from (text, toxic) rows, and the prior log odds.

    A feature's evidence is its smoothed log odds less ``confidence`` standard errors, so rare features say nothing. The
    ``most`` strongest are kept: the model's size is bounded, the counts behind it cover all labelled rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = CharModel(characters), {}
        for batch in batches:
            seen = (Counter(), Counter())
            for value, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(_features(clear_words(value, model, known)) | {""})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.record_batch(
                [pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in seen)],
                names=["feature", "clean", "toxic"],
            )

    counts = labelled.mapInArrow(count, "feature string, clean long, toxic long")
    counts = written(counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-words")
    sums = counts.where("feature = ''").first()
    clean, toxic = (sums["clean"] + 1, sums["toxic"] + 1) if sums else (1, 1)
    prior = math.log(toxic / clean)
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - prior
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    rated = counts.where("feature != '' and toxic > 2").select("feature", "clean", "toxic", (odds - confidence * error).alias("e"))
    rated = rated.where(F.col("e") > _LEAST).orderBy(F.desc("e"), "feature").limit(most)
    return {r["feature"]: (r["toxic"], r["clean"]) for r in rated.collect()}, prior


_LEAST, _STEP, _CELLS = 0.3, 0.5, 24


def _reading(found: set[str], counts: dict[str, tuple[int, int]], prior: float, confidence: float = 2.0, label: int | None = None) -> tuple[float, float]:
    """Evidence of the two strongest words and of the strongest word beginning; a labelled text does not count for itself."""
    words, beginnings = [], [0.0]
    for f in found & counts.keys():
        toxic, clean = counts[f]
        if label is not None:
            toxic, clean = toxic - label, clean - (1 - label)
        e = math.log((toxic + 0.5) / (clean + 0.5)) - prior - confidence * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if e > _LEAST:
            if f[-1] != "*":
                words.append(e)
            elif toxic >= 9 * clean:
                beginnings.append(e)
    return sum(sorted(words, reverse=True)[:2]), max(beginnings)


def _cell(reading: tuple[float, float]) -> int:
    return min(int(reading[0] / _STEP), _CELLS - 1) * _CELLS + min(int(reading[1] / _STEP), _CELLS - 1)


def calibrate(labelled: DataFrame, characters: dict[str, int], counts: dict[str, tuple[int, int]], prior: float) -> dict[int, tuple[int, int]]:
    """How many labelled texts of each kind have each pair of rounded readings (at most ``_CELLS`` squared)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = CharModel(characters), {}
        for batch in batches:
            seen: Counter = Counter()
            for value, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[_cell(_reading(_features(clear_words(value, model, known)), counts, prior, label=label)), label] += 1
            rows = [(c, n * (1 - label), n * label) for (c, label), n in seen.items()]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["cell", "clean", "toxic"])

    sums = labelled.mapInArrow(read, "cell long, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return {r["cell"]: (r["toxic"], r["clean"]) for r in sums.collect()}


def score_toxicity(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` (1 from ``threshold`` on).

    ``labels`` has ``text`` and ``toxic`` and is what the score learns from. Every text is restored first: tokens with
    digits or marks among letters, long runs of a letter and spaced-out characters become lattices of letters and word
    boundaries, decoded whole by Viterbi
    under a character model of ``all_docs`` (``docs`` by default). The log odds of the restored text are the prior plus the evidence of its
    two strongest words or of its strongest word beginning, whichever is more; this guess counts as two texts beside the
    labelled texts with the same readings, of which the score is the toxic share. Null and empty texts get the prior's score, repeated rows the same score, and
    an empty table no rows; without labels every score is a half. Columns named like a new one are replaced.
    """
    characters = fit_characters(docs if all_docs is None else all_docs, text)
    labelled = labels.where("toxic in (0, 1)").select(text_or_empty("text").alias("t"), F.col("toxic").cast("int"))
    counts, prior = fit_words(labelled, characters)
    cells = calibrate(labelled, characters, counts, prior)
    docs = docs.drop("score", "predicted")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = CharModel(characters), {}
        for batch in batches:
            scores = []
            for value in batch.column(text).to_pylist():
                reading = _reading(_features(clear_words(value or "", model, known)), counts, prior)
                logit = prior + max(reading)  # the two overlap, so they are not added up
                guess = 1 / (1 + math.exp(-max(min(logit, 30.0), -30.0)))
                toxic, clean = cells.get(_cell(reading), (0, 0))
                scores.append((toxic + 2 * guess) / (toxic + clean + 2))
            columns = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.record_batch(columns, names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(score, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
