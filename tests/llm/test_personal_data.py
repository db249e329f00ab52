"""Personal data: patterns against plain regular expressions, the tagger against enumeration, held-out spellings."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
from fixtures import sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfgrid.llm import char_tagger as ct
from shelfgrid.llm.personal_data import KINDS, STRIDE, WINDOW, base_spans, find_personal_data, luhn, reconciled, train_tagger, windows_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append(m.span())
        out[kind] = spans
    return out


def with_luhn(rng):
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def datum(rng, kind):
    if kind == "email":
        return f"{rng.choice('abcdefgh')}{rng.choice(['ana', 'bo.lee', 'kim'])}{rng.randrange(99)}@{rng.choice(['mail', 'post'])}{rng.randrange(9)}.example.com"
    if kind == "ip":
        return ".".join(str(rng.randrange(1, 256)) for _ in range(4))
    if kind == "card":
        return with_luhn(rng)
    return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="01259. -+()@aZ_%é\n", max_size=60))
def test_patterns(text):
    assert base_spans(text) == plain(text)


def test_patterns_find_what_they_should():
    rng = random.Random(8)
    for kind in KINDS:
        for _ in range(50):
            text = f"é {datum(rng, kind)}, {datum(rng, rng.choice(KINDS))} {datum(rng, kind)}."
            assert base_spans(text) == plain(text) and base_spans(text)[kind]


def test_hostile_texts_take_linear_time():
    started = time.time()
    for text in ("1" * 10**6, "a" * 10**6, "1." * 500_000, "+1(" * 300_000, "+1" + "(" * 10**6, "a@" * 500_000, "@" + "a" * 10**6, "1 " * 500_000 + "x"):
        base_spans(text)
        windows_of(text)
    assert time.time() - started < 30


def test_every_sign_lies_in_a_window():
    rng = random.Random(1)
    for n in (0, 1, 50, WINDOW, WINDOW + 1, 1000, 5000):
        text = "".join(rng.choice("aaaaaaaaaaaaaaaaaaaaaaaaa 7") for _ in range(n))
        starts = windows_of(text)
        assert starts == sorted(set(starts)) and all(s % STRIDE == 0 for s in starts)
        assert all(any(s <= i < s + WINDOW for s in starts) for i, c in enumerate(text) if c == "7")


def small(seed=0, kinds=2, hidden=3):
    rng = np.random.default_rng(seed)
    p = {k: v.astype(np.float64) for k, v in ct.new_parameters(kinds, hidden, seed).items()}
    p["move"] = rng.normal(size=p["move"].shape)
    chars = rng.integers(0, ct.ALPHABET, (5, 2))
    return p, chars, np.array([[0, 1], [1, 2], [2, 0], [2, 3], [0, 4]])


def chains(p, length):
    free = ct.allowed(len(p["bias"]) // 2)
    return [c for c in itertools.product(range(len(free)), repeat=length) if all(free[a, b] for a, b in zip(c, c[1:]))]


def test_loss_and_best_chain_by_enumeration():
    p, chars, tags = small()
    scores, _ = ct.emissions(p, chars)
    loss, _ = ct.loss_and_gradient(p, chars, tags)
    total, best = 0.0, ct.best_tags(p, scores)
    for b in range(2):
        def value(c):
            return sum(scores[t, k, b] for t, k in enumerate(c)) + sum(p["move"][x, y] for x, y in zip(c, c[1:]))
        values = {c: value(c) for c in chains(p, 5)}
        total += np.log(sum(np.exp(v) for v in values.values())) - values[tuple(tags[:, b])]
        assert tuple(best[:, b]) == max(values, key=values.get)
    assert abs(loss - total / 2) < 1e-6


def test_gradient_by_finite_differences():
    p, chars, tags = small(3)
    _, slopes = ct.loss_and_gradient(p, chars, tags)
    rng = np.random.default_rng(5)
    for name, value in p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name.endswith("_in"):
                at = (at[0], int(rng.choice(chars.ravel())))
            if name == "move" and not ct.allowed(2)[at]:
                assert slopes[name][at] == 0
                continue
            old, seen = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                seen.append(ct.loss_and_gradient(p, chars, tags)[0])
            value[at] = old
            assert abs((seen[0] - seen[1]) / 2e-5 - slopes[name][at]) < 1e-5


def test_windows_are_reconciled_over_the_text():
    text = "x" * 20 + "(269) 555-3296" + "y" * 20
    cut = [(20, 28, 3, 5.0, False, True), (24, 34, 3, 6.0, True, False), (20, 25, 1, 2.0, False, False)]
    assert reconciled(text, cut, {}) == [(3, 20, 34)]
    assert reconciled(text, cut, {"email": [(33, 40)]}) == []
    assert reconciled("a 4661320592814900 b", [(2, 15, 2, 9.0, False, False)], {}) == []


def test_personal_data(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        words = sentence(rng, rng.randrange(5, 80)).split()
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), datum(rng, rng.choice(KINDS)))
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, rows[3][1]), (903, "é" * 300 + " " + datum(rng, "email")), (904, (sentence(rng, 60) + " " + datum(rng, "phone") + " ") * 300)]
    rows += [rows[3], rows[3]]
    other = [(1000 + i, f"{sentence(rng, 20)} {rng.randrange(200, 999)}-555-{rng.randrange(1000, 9999)} {sentence(rng, 9)}") for i in range(40)]
    docs = spark.createDataFrame(rows + other, "doc_id long, text string").withColumns({"spans": F.lit(3), "lang": F.lit("xx"), "model": F.lit(1)})
    model = train_tagger(docs.where("doc_id < 1000"))  # the other spellings are held out
    out = find_personal_data(docs, model)
    assert out.columns[:3] == ["doc_id", "lang", "model"]
    found = out.collect()
    assert len(found) == len(rows) + len(other)
    texts, new = dict(rows + other), 0
    for r in found:
        base = plain(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in KINDS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed.split(",")) - {""} <= set(spans) and len(spans) == len(set(spans)) == sum(map(len, base.values())) + r.n_added
        if r.doc_id >= 1000:
            new += r.n_added > 0
    assert new >= 30  # numbers without a country code, which no pattern has
    assert sum(r.n_added for r in found if r.doc_id < 1000) <= 6
    none = find_personal_data(docs.limit(0), None)
    assert none.count() == 0 and train_tagger(docs.where("doc_id = 900")) is None
    assert find_personal_data(docs, None).agg(F.sum("n_added")).first()[0] == 0
