"""Tagging of characters: an LSTM in either direction under a chain of tags (CRF), in NumPy.

Arrays are laid out features x batch. Tag 0 is outside; kind ``k`` begins with tag ``1 + 2k`` and goes on with ``2 + 2k``.
"""

from __future__ import annotations

import io

import numpy as np

ALPHABET = 130  # ASCII by itself, 128 for what is beyond, 129 for what lies behind the end of a text
PAD = 129
_NEVER = np.float32(-1e4)


def encoded(text: str, length: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")[:length]
    out = np.full(length, PAD, dtype=np.int64)
    out[: len(codes)] = np.minimum(codes, 128)
    return out


def allowed(kinds: int) -> np.ndarray:
    """allowed[a, b]: tag ``b`` may follow tag ``a``; a span goes on only in its own kind."""
    tags = 1 + 2 * kinds
    out = np.ones((tags, tags), dtype=bool)
    for k in range(kinds):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


def new_parameters(kinds: int, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng, tags = np.random.default_rng(seed), 1 + 2 * kinds

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    out = {"emit": drawn(tags, 2 * hidden, scale=0.2), "bias": np.zeros((tags, 1), np.float32), "move": np.zeros((tags, tags), np.float32)}
    for way in ("ahead", "back"):
        out[f"{way}_in"] = drawn(4 * hidden, ALPHABET, scale=0.3)
        out[f"{way}_in"][hidden : 2 * hidden] += 1  # forget little at first
        out[f"{way}_loop"] = drawn(4 * hidden, hidden, scale=0.3)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(inputs: np.ndarray, loop: np.ndarray, chars: np.ndarray, keep: bool):
    """Hidden states (length, hidden, batch) over ``chars`` (length, batch), and what the way back needs if ``keep``."""
    h = loop.shape[1]
    hidden = np.zeros((h, chars.shape[1]), dtype=loop.dtype)
    cell, states, kept = np.zeros_like(hidden), np.empty((len(chars), *hidden.shape), dtype=loop.dtype), []
    for t, at in enumerate(chars):
        gates = inputs[:, at] + loop @ hidden
        gates[: 3 * h] = _sigmoid(gates[: 3 * h])
        gates[3 * h :] = np.tanh(gates[3 * h :])
        if keep:
            kept.append((gates, cell, hidden))
        cell = gates[h : 2 * h] * cell + gates[:h] * gates[3 * h :]
        hidden = gates[2 * h : 3 * h] * np.tanh(cell)
        states[t] = hidden
    return states, kept


def _lstm_gradient(loop: np.ndarray, chars: np.ndarray, kept: list, slopes: np.ndarray):
    """Gradients of (inputs, loop) from the gradients ``slopes`` of all hidden states."""
    h, batch = loop.shape[1], chars.shape[1]
    by_gate = np.empty((len(chars), 4 * h, batch), dtype=loop.dtype)
    d_loop = np.zeros_like(loop)
    d_hidden, d_cell = np.zeros((h, batch), loop.dtype), np.zeros((h, batch), loop.dtype)
    for t in range(len(chars) - 1, -1, -1):
        gates, cell, hidden = kept[t]
        i, f, o, z = gates[:h], gates[h : 2 * h], gates[2 * h : 3 * h], gates[3 * h :]
        out = np.tanh(f * cell + i * z)
        d_hidden = d_hidden + slopes[t]
        d_cell = d_cell + d_hidden * o * (1 - out * out)
        d = by_gate[t]
        d[:h], d[h : 2 * h] = d_cell * z * i * (1 - i), d_cell * cell * f * (1 - f)
        d[2 * h : 3 * h], d[3 * h :] = d_hidden * out * o * (1 - o), d_cell * i * (1 - z * z)
        d_loop += d @ hidden.T
        d_hidden, d_cell = loop.T @ d, d_cell * f
    one_hot = np.zeros((chars.size, ALPHABET), dtype=loop.dtype)
    one_hot[np.arange(chars.size), chars.ravel()] = 1
    return by_gate.transpose(1, 0, 2).reshape(4 * h, -1) @ one_hot, d_loop


def emissions(p: dict[str, np.ndarray], chars: np.ndarray, keep: bool = False):
    """Scores (length, tags, batch) of every tag at every character of ``chars`` (length, batch)."""
    ahead, kept_ahead = _lstm(p["ahead_in"], p["ahead_loop"], chars, keep)
    back, kept_back = _lstm(p["back_in"], p["back_loop"], chars[::-1], keep)
    states = np.concatenate((ahead, back[::-1]), axis=1)
    return p["emit"] @ states + p["bias"], (states, kept_ahead, kept_back)


def moves(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(allowed(len(p["bias"]) // 2), p["move"], p["move"].dtype.type(_NEVER))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def loss_and_gradient(p: dict[str, np.ndarray], chars: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood of the tag chains (length, batch), and its gradient."""
    length, batch = chars.shape
    scores, (states, kept_ahead, kept_back) = emissions(p, chars, keep=True)
    move, n = moves(p), scores.shape[1]
    before, behind = np.empty_like(scores), np.zeros_like(scores)
    before[0] = scores[0]
    for t in range(1, length):
        before[t] = scores[t] + _log_sum(before[t - 1][:, None, :] + move[:, :, None], 0)
    for t in range(length - 2, -1, -1):
        behind[t] = _log_sum(move[:, :, None] + (scores[t + 1] + behind[t + 1])[None, :, :], 1)
    whole = _log_sum(before[-1], 0)
    columns = np.arange(batch)
    taken = sum(scores[t, tags[t], columns] for t in range(length)) + move[tags[:-1], tags[1:]].sum(axis=0)
    d_scores = np.exp(before + behind - whole)
    d_move = np.zeros((n, n), dtype=scores.dtype)
    for t in range(1, length):
        pair = before[t - 1][:, None, :] + move[:, :, None] + (scores[t] + behind[t])[None, :, :] - whole
        d_move += np.exp(pair).sum(axis=2)
    np.subtract.at(d_move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    for t in range(length):
        d_scores[t, tags[t], columns] -= 1
    d_scores /= batch
    d_states = p["emit"].T @ d_scores
    h = p["ahead_loop"].shape[1]
    slopes = {"emit": np.einsum("ltb,lhb->th", d_scores, states, optimize=True), "bias": d_scores.sum(axis=(0, 2))[:, None]}
    slopes["move"] = np.where(allowed(n // 2), d_move / batch, 0).astype(scores.dtype)
    slopes["ahead_in"], slopes["ahead_loop"] = _lstm_gradient(p["ahead_loop"], chars, kept_ahead, d_states[:, :h])
    slopes["back_in"], slopes["back_loop"] = _lstm_gradient(p["back_loop"], chars[::-1], kept_back, d_states[::-1, h:])
    return float((whole - taken).mean()), slopes


def fitted(chars: np.ndarray, tags: np.ndarray, kinds: int, hidden: int, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 7):
    """Parameters after ``steps`` steps of Adam over windows ``chars`` and ``tags`` (windows, length)."""
    p, rng = new_parameters(kinds, hidden, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.choice(len(chars), size=min(batch, len(chars)), replace=False)
        _, slopes = loss_and_gradient(p, chars[at].T, tags[at].T)
        norm = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
        now = rate * (1 - 0.9 * step / steps)
        for k, g in slopes.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def best_tags(p: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """The chain of highest score for each column (Viterbi): tags (length, batch), ties to the smaller tag."""
    move, length = moves(p), len(scores)
    best, came = scores[0], np.zeros(scores.shape, dtype=np.int8)
    for t in range(1, length):
        step = best[:, None, :] + move[:, :, None]
        came[t] = step.argmax(axis=0)
        best = scores[t] + step.max(axis=0)
    out = np.empty((length, scores.shape[2]), dtype=np.int64)
    out[-1] = best.argmax(axis=0)
    for t in range(length - 1, 0, -1):
        out[t - 1] = came[t][out[t], np.arange(scores.shape[2])]
    return out


def dumped(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def loaded(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as stored:
        return {k: stored[k] for k in stored.files}
