"""A gated recurrent language model in numpy.

A token is a head word, or one of the tail classes that the other words fall into by
their ending. The output is factored by class: P(class | h), then P(token | class, h);
the last classes hold the tail. Documents lie one after another
on lanes; the state starts at zero with each document and is carried from window to
window, so whole documents are scored, and gradients are cut at window borders.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 64, 128
HEAD = HEAD_CLASSES * CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL_CLASSES // CLASS_WORDS
#: The end of a document is the first head word; it also stands before the first word.
END = 0
INPUTS = HEAD + TAIL_CLASSES
#: Rows whose class scores are held at once, to stay in the processor's cache.
STRIP = 1024
#: Output weights are kept within this, so that no exponential overflows.
MOST_WEIGHT = 4.0
EMBED, HIDDEN = 16, 16
SHAPES = {
    "emb": (INPUTS, EMBED), "Wx": (EMBED, 3 * HIDDEN), "bx": (3 * HIDDEN,), "Uh": (HIDDEN, 3 * HIDDEN),
    "C": (HIDDEN, CLASSES), "bc": (CLASSES,), "O": (CLASSES, HIDDEN, CLASS_WORDS), "bo": (CLASSES, CLASS_WORDS),
}


def initial(head_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters whose output without any state is the add-one unigram model."""
    r = np.random.default_rng(seed)
    p = {k: np.zeros(s, dtype=np.float32) for k, s in SHAPES.items()}
    p["emb"][:] = r.normal(0, 0.5, SHAPES["emb"])
    p["Wx"][:] = r.normal(0, 1 / np.sqrt(EMBED), SHAPES["Wx"])
    p["Uh"][:] = r.normal(0, 1 / np.sqrt(HIDDEN), SHAPES["Uh"])
    p["bx"][:HIDDEN] = 1.0  # keep the state at first
    counts = np.concatenate([head_counts, tail_counts]).reshape(CLASSES, CLASS_WORDS) + 1.0
    p["bo"][:] = np.log(counts / counts.sum(axis=1, keepdims=True))
    p["bc"][:] = np.log(counts.sum(axis=1) / counts.sum())
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


@dataclass
class Lanes:
    """Documents laid on lanes, longest lane first; entry [t, lane] of each array, -1 past a lane's end."""

    into: np.ndarray
    target: np.ndarray
    doc: np.ndarray
    fresh: np.ndarray
    length: np.ndarray


def lay(tokens: np.ndarray, first: np.ndarray, n_lanes: int) -> Lanes:
    """Lay documents (token targets, each ended by END) on lanes of even length."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    heap = [(0, i) for i in range(min(n_lanes, len(sizes)))]
    lanes: list[list[int]] = [[] for _ in heap]
    for d in order.tolist():
        load, lane = heapq.heappop(heap)
        lanes[lane].append(d)
        heapq.heappush(heap, (load + int(sizes[d]), lane))
    lanes.sort(key=lambda x: -int(sizes[x].sum()))
    length = np.array([int(sizes[x].sum()) for x in lanes])
    shape = (int(length.max()), len(lanes))
    into, target, doc = (np.full(shape, -1, dtype=np.int32) for _ in range(3))
    fresh = np.zeros(shape, dtype=bool)
    before = np.full_like(tokens, END)  # every document ends with END
    before[1:] = tokens[:-1]
    for i, docs in enumerate(lanes):
        at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        n = len(at)
        into[:n, i], target[:n, i] = before[at], tokens[at]
        doc[:n, i] = np.repeat(docs, sizes[docs])
        fresh[np.cumsum([0, *sizes[docs][:-1]]), i] = True
    return Lanes(into, target, doc, fresh, length)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Adam:
    rate: float
    mean: dict = field(default_factory=dict)
    square: dict = field(default_factory=dict)
    step: int = 0

    def update(self, p: dict, g: dict) -> None:
        self.step += 1
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        for k, v in g.items():
            v = v * scale
            if k not in self.mean:
                self.mean[k], self.square[k] = np.zeros_like(v), np.zeros_like(v)
            m, s = self.mean[k], self.square[k]
            m += np.float32(0.1) * (v - m)
            s += np.float32(0.01) * (v * v - s)
            p[k] -= np.float32(self.rate / (1 - 0.9 ** self.step)) * m / (
                np.sqrt(s / np.float32(1 - 0.99 ** self.step)) + np.float32(1e-6))
            if k in ("C", "O"):
                np.clip(p[k], -MOST_WEIGHT, MOST_WEIGHT, out=p[k])


def _steps(p: dict, table: np.ndarray, lanes: Lanes, t0: int, t1: int, h: np.ndarray, keep: bool):
    """Run steps t0 … t1; returns states by step, and what the backward pass needs."""
    states, saved = [], []
    for t in range(t0, t1):
        n = int(np.searchsorted(-lanes.length, -t))  # lanes longer than t
        before = h[:n] * ~lanes.fresh[t, :n, None]
        x = table[lanes.into[t, :n]]
        u = before @ p["Uh"]
        gates = _sigmoid(x[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
        after = c + z * (before - c)
        h[:n] = after
        states.append(after)
        if keep:
            saved.append((n, before, z, r, c, u[:, 2 * HIDDEN:]))
    return states, saved


def _outputs(p: dict, s: np.ndarray, target: np.ndarray, gradient: bool):
    """Natural log-probability of each target, and gradients."""
    cls, word = target // CLASS_WORDS, target % CLASS_WORDS
    logp = np.empty(len(s), dtype=np.float32)
    g, ds = {}, None
    if gradient:
        ds = np.empty_like(s)
        g = {k: np.zeros_like(p[k]) for k in ("C", "bc", "O", "bo")}

    def softmax(rows, own: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        """Adds the log-probability of ``own`` to rows; gives the score gradient."""
        e = rows @ weights
        e += bias
        at = np.arange(len(e))
        picked = e[at, own]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], dtype=np.float32)
        if gradient:
            e *= (1 / total)[:, None]
            e[at, own] -= 1
        return picked - np.log(total), e

    for a in range(0, len(s), STRIP):
        strip = slice(a, a + STRIP)
        logp[strip], e = softmax(s[strip], cls[strip], p["C"], p["bc"])
        if gradient:
            ds[strip] = e @ p["C"].T
            g["C"] += s[strip].T @ e
            g["bc"] += np.ones(len(e), dtype=np.float32) @ e
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        rows = order[bounds[k]:bounds[k + 1]]
        if not len(rows):
            continue
        part = s[rows]
        more, e = softmax(part, word[rows], p["O"][k], p["bo"][k])
        logp[rows] += more
        if gradient:
            ds[rows] += e @ p["O"][k].T
            g["O"][k], g["bo"][k] = part.T @ e, np.ones(len(e), dtype=np.float32) @ e
    return logp, g, ds


def train(
    p: dict, tokens: np.ndarray, first: np.ndarray, adam: Adam, *, window: int = 16, updates: int = 120,
    least_lanes: int = 16, most_lanes: int = 512, stretch: int = 1024,
) -> None:
    """One pass of truncated backpropagation over all tokens; changes ``p``.

    The number of lanes follows the tokens, so that a pass makes about ``updates`` updates
    or more at any size. Documents are laid in stretches of at most ``stretch`` tokens,
    each with a zero state at its start, so that one long document doesn't run on alone.
    """
    n_lanes = int(np.clip(len(tokens) // (window * updates), least_lanes, most_lanes))
    pieces = -(-np.diff(first) // stretch)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lanes = lay(tokens, np.append(np.repeat(first[:-1], pieces) + nth * stretch, first[-1]), n_lanes)
    h = np.zeros((lanes.into.shape[1], HIDDEN), dtype=np.float32)
    for t0 in range(0, len(lanes.into), window):
        t1 = min(t0 + window, len(lanes.into))
        table = p["emb"] @ p["Wx"] + p["bx"]
        states, saved = _steps(p, table, lanes, t0, t1, h, True)
        counts = [len(s) for s in states]
        target = np.concatenate([lanes.target[t0 + i, :n] for i, n in enumerate(counts)])
        _, g, ds = _outputs(p, np.concatenate(states), target, True)
        at = np.concatenate([[0], np.cumsum(counts)])
        dx = np.empty((len(target), 3 * HIDDEN), dtype=np.float32)
        back, uh = np.zeros_like(h), np.zeros_like(p["Uh"])
        for i in range(t1 - t0 - 1, -1, -1):
            n, before, z, r, c, un = saved[i]
            dh = ds[at[i]:at[i + 1]] + back[:n]
            dc = dh * (1 - z) * (1 - c * c)
            d = dx[at[i]:at[i + 1]]
            d[:, :HIDDEN] = dh * (before - c) * z * (1 - z)
            d[:, HIDDEN:2 * HIDDEN] = dc * un * r * (1 - r)
            d[:, 2 * HIDDEN:] = dc
            du = d.copy()
            du[:, 2 * HIDDEN:] *= r
            uh += before.T @ du
            back[:n] = (dh * z + du @ p["Uh"].T) * ~lanes.fresh[t0 + i, :n, None]
        into = np.concatenate([lanes.into[t0 + i, :n] for i, n in enumerate(counts)])
        order = np.argsort(into, kind="stable")
        rows, starts = np.unique(into[order], return_index=True)
        sums = np.add.reduceat(dx[order], starts, axis=0)
        g["emb"] = np.zeros_like(p["emb"])
        g["emb"][rows] = sums @ p["Wx"].T
        g["Wx"], g["bx"], g["Uh"] = p["emb"][rows].T @ sums, sums.sum(axis=0), uh
        scale = np.float32(1 / len(target))
        adam.update(p, {k: v * scale for k, v in g.items()})


def score(p: dict, tokens: np.ndarray, first: np.ndarray, *, window: int = 32, n_lanes: int = 512) -> np.ndarray:
    """Natural log-probability of each whole document."""
    lanes = lay(tokens, first, n_lanes)
    h = np.zeros((lanes.into.shape[1], HIDDEN), dtype=np.float32)
    table = p["emb"] @ p["Wx"] + p["bx"]
    out = np.zeros(len(first) - 1)
    for t0 in range(0, len(lanes.into), window):
        t1 = min(t0 + window, len(lanes.into))
        states, _ = _steps(p, table, lanes, t0, t1, h, False)
        counts = [len(s) for s in states]
        logp, _, _ = _outputs(p, np.concatenate(states), np.concatenate(
            [lanes.target[t0 + i, :n] for i, n in enumerate(counts)]), False)
        doc = np.concatenate([lanes.doc[t0 + i, :n] for i, n in enumerate(counts)])
        out += np.bincount(doc, weights=logp, minlength=len(out))
    return out
