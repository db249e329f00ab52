"""Small corpora with the awkward cases, and plain loops to hold the operators against."""

import random
from collections import Counter, defaultdict

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau straße été ñandú".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def corpus(seed=3, n=60):
    """(doc_id, text) rows: copies, near copies, a passage many share, nulls, empty and long texts, a repeated row."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.randrange(1, 200))) for i in range(n)]
    for i in range(0, n, 6):
        rows[i] = (i, rows[i][1][:300] + " " + passage + " " + sentence(rng, 30))
    base = sentence(rng, 150).split()
    for i in range(n, n + 20):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
        rows.append((i, " ".join(words)))
    rows += [(n + 20, None), (n + 21, ""), (n + 22, None), (n + 23, " \n\t "), (n + 24, rows[1][1]), (n + 25, rows[1][1].upper())]
    rows += [(n + 26, "aé" * 400), (n + 27, sentence(rng, 4)), (n + 28, sentence(rng, 20_000))]
    rows.append((n + 29, rows[-3][1] + "aé" * 90))
    return [*rows, rows[3]]


def components(rows, words=5, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, own in enumerate(sets):
        for j, k in Counter(j for g in own for j in where[g]).items():
            if 100 * k >= percent * (len(own) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in own:
            where[g].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def repeats(rows, length=200):
    import hashlib

    texts = [(text or "").encode() for _, text in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone, last = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                for j in range(max(i, last), i + length):
                    gone[j] = 1
                last = i + length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)
