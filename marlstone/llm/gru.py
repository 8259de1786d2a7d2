"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows.

Documents run side by side as the columns of a batch; every function here works on one batch and leaves dealing to Spark.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import islice

import numpy as np

NAMES = ("wx", "u", "wc", "bc", "wo", "bo")


def start(counts: np.ndarray, hidden: int, members: int, seed: int = 17) -> dict[str, np.ndarray]:
    """Weights before training: the softmax begins at the tokens' frequencies. counts: of each id, a multiple of members long."""
    rng = np.random.default_rng(seed)
    v, c = len(counts), len(counts) // members
    p = (counts + 0.5).astype(np.float64).reshape(c, members)
    w = {
        "wx": rng.normal(0, 0.1, (v, 3 * hidden)),
        "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)),
        "wc": rng.normal(0, 0.1, (hidden, c)),
        "bc": np.log(p.sum(1) / p.sum()),
        "wo": rng.normal(0, 0.1, (c, hidden, members)),
        "bo": np.log(p / p.sum(1, keepdims=True)),
    }
    return {k: x.astype(np.float32) for k, x in w.items()}


def dump(w: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in NAMES}


def forward(w: dict[str, np.ndarray], prev: np.ndarray, h: np.ndarray, keep: bool = False):
    """States after each of the steps of prev (steps, batch), from state h; keep also gives what backpropagation needs: (gates, candidates, their recurrent part)."""
    n, hid = prev.shape[0], h.shape[1]
    states = np.empty((n, *h.shape), dtype=h.dtype)
    gates = np.empty((n if keep else 1, len(h), 2 * hid), dtype=h.dtype)
    news, parts = (np.empty((n if keep else 1, *h.shape), dtype=h.dtype) for _ in range(2))
    u, xs = w["u"], w["wx"][prev]
    for t in range(n):
        x, g, k = xs[t], h @ u, t if keep else 0
        zr = np.add(x[:, : 2 * hid], g[:, : 2 * hid], out=gates[k])
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        new = np.multiply(zr[:, hid:], g[:, 2 * hid :], out=news[k])
        new += x[:, 2 * hid :]
        np.tanh(new, out=new)
        if keep:
            parts[t] = g[:, 2 * hid :]
        h = np.subtract(h, new, out=states[t])
        h *= zr[:, :hid]
        h += new
    return states, h, (gates, news, parts)


def output(w: dict[str, np.ndarray], states: np.ndarray, ids: np.ndarray, grad: bool = False):
    """Natural log probability of each id after its state (rows); grad: also the gradients of minus their sum.

    First the id's class among all, then the id within its class. Scores stay far below what exp holds, as gradients are clipped.
    """
    members = w["bo"].shape[1]
    cls, mem = ids // members, ids % members
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(w["bo"].shape[0] + 1))
    states, cls, mem = states[order], cls[order], mem[order]  # by class, so that each has one block

    def softmax(x: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = x[np.arange(len(x)), pick]
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], dtype=x.dtype)
        return at - np.log(total), x if not grad else x / total[:, None]

    lc, dc = softmax(states @ w["wc"] + w["bc"], cls)
    if grad:
        dc[np.arange(len(dc)), cls] -= 1
        g = {"wc": states.T @ dc, "bc": dc.sum(0), "wo": np.zeros_like(w["wo"]), "bo": np.zeros_like(w["bo"])}
        dstates = dc @ w["wc"].T
    for c in range(len(cuts) - 1):
        a, b = cuts[c], cuts[c + 1]
        if b > a:
            s = states[a:b]
            lm, dm = softmax(s @ w["wo"][c] + w["bo"][c], mem[a:b])
            lc[a:b] += lm
            if grad:
                dm[np.arange(b - a), mem[a:b]] -= 1
                g["wo"][c], g["bo"][c] = s.T @ dm, dm.sum(0)
                dstates[a:b] += dm @ w["wo"][c].T
    logp = np.empty(len(ids))
    logp[order] = lc
    if not grad:
        return logp
    back = np.empty_like(dstates)
    back[order] = dstates
    return logp, g, back


def windows(docs: list[np.ndarray], end: int, width: int):
    """(previous ids, ids, lengths left, first) of each window of width steps over documents sorted by falling length; those that have ended leave the batch."""
    lengths = np.array([len(d) for d in docs])
    for at in range(0, int(lengths[0]) if len(docs) else 0, width):
        live = int((lengths > at).sum())
        n = min(width, int(lengths[0]) - at)
        ids, prev = np.zeros((n, live), dtype=np.int64), np.full((n, live), end, dtype=np.int64)
        for j in range(live):
            own = docs[j][at : at + n]
            ids[: len(own), j] = own
            if at:
                prev[0, j] = docs[j][at - 1]
        prev[1:] = ids[:-1]
        yield prev, ids, lengths[:live] - at, at == 0


def score(w: dict[str, np.ndarray], docs: list[np.ndarray], end: int, width: int = 64) -> np.ndarray:
    """Natural log probability of each whole document; docs sorted by falling length."""
    total = np.zeros(len(docs))
    h = np.zeros((len(docs), w["u"].shape[0]), dtype=w["u"].dtype)
    for prev, ids, left, _ in windows(docs, end, width):
        live = prev.shape[1]
        states, h, _ = forward(w, prev, h[:live])
        real = np.arange(len(ids))[:, None] < left[None, :]
        logp = np.zeros(ids.shape)
        logp[real] = output(w, states[real], ids[real])
        total[:live] += logp.sum(0)
    return total


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.n = w, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.v = {k: np.zeros_like(x) for k, x in w.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.w[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)).astype(np.float32)


def _gradients(w: dict[str, np.ndarray], prev: np.ndarray, ids: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of minus the sum of the real ids' log probabilities over one window from state h, and the states after it."""
    hid, first = w["u"].shape[0], h
    states, h, (gates, new, part) = forward(w, prev, h, keep=True)
    _, g, d = output(w, states[real], ids[real], grad=True)
    dstates = np.zeros_like(states)
    dstates[real] = d
    z, r = gates[..., :hid], gates[..., hid:]
    before = np.concatenate([first[None], states[:-1]])
    # What a unit of each state's gradient gives to the candidate, and to the three parts of the recurrent product, for all steps at once.
    to_new = (1 - z) * (1 - new * new)
    to_parts = np.stack([(before - new) * z * (1 - z), to_new * part * r * (1 - r), to_new * r], axis=2)
    dparts, ut = np.empty_like(to_parts), np.ascontiguousarray(w["u"].T)
    dh = np.zeros_like(h)
    for t in reversed(range(len(ids))):
        dh = np.add(dstates[t], dh, out=dstates[t])
        dg = np.multiply(dh[:, None, :], to_parts[t], out=dparts[t]).reshape(len(h), 3 * hid)
        dh = dh * z[t]
        dh += dg @ ut
    dx = dparts.reshape(*ids.shape, 3 * hid)
    du = before.reshape(-1, hid).T @ dx.reshape(-1, 3 * hid)
    dx[..., 2 * hid :] = dstates * to_new
    flat, rows = prev[real], dx[real]
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    g["wx"] = np.zeros_like(w["wx"])
    g["wx"][flat[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    g["u"] = du
    return g, h


def _update(adam: Adam, g: dict[str, np.ndarray], n: int) -> None:
    """A step by the mean over n tokens of the gradients g, of length 1 at most."""
    scale = 1.0 / max(1, n)
    size = np.sqrt(sum(float((x * x).sum()) for x in g.values())) * scale
    scale *= min(1.0, 1.0 / max(size, 1e-9))
    adam.step({k: x * np.float32(scale) for k, x in g.items()})


def train(adam: Adam, docs: list[np.ndarray], end: int, width: int = 32) -> int:
    """One pass over the documents (sorted by falling length), an update for each window; gradients stop at a window's start, states go on."""
    w, seen = adam.w, 0
    h = np.zeros((len(docs), w["u"].shape[0]), dtype=w["u"].dtype)
    for prev, ids, left, _ in windows(docs, end, width):
        real = np.arange(len(ids))[:, None] < left[None, :]
        g, h = _gradients(w, prev, ids, real, h[: prev.shape[1]])
        n = int(real.sum())
        _update(adam, g, n)
        seen += n
    return seen


def train_stream(adam: Adam, docs: Iterator[np.ndarray], end: int, lanes: int = 128, width: int = 32, least: int = 2048) -> int:
    """One pass over all tokens of the documents in their order, `lanes` of them side by side; returns the tokens.

    Where a document has ended, the next one takes its lane at the start of a window, from an empty state; a longer one goes on from
    its own state and last token. Windows of under `least` tokens, as the documents run out, are added up before an update.
    """
    w, hid, seen, n = adam.w, adam.w["u"].shape[0], 0, 0
    docs = (d for d in docs if len(d))
    live: list[tuple[np.ndarray, int]] = []
    h, total = np.zeros((0, hid), dtype=w["u"].dtype), None
    while True:
        stay = [j for j, (d, at) in enumerate(live) if at < len(d)]
        live = [live[j] for j in stay]
        live += [(d, 0) for d in islice(docs, lanes - len(live))]
        if not live:
            break
        h = np.concatenate([h[stay], np.zeros((len(live) - len(stay), hid), dtype=h.dtype)])
        sizes = np.array([min(width, len(d) - at) for d, at in live])
        ids, prev = np.zeros((sizes.max(), len(live)), dtype=np.int64), np.full((sizes.max(), len(live)), end, dtype=np.int64)
        for j, (d, at) in enumerate(live):
            ids[: sizes[j], j] = d[at : at + width]
            if at:
                prev[0, j] = d[at - 1]
        prev[1:] = ids[:-1]
        g, h = _gradients(w, prev, ids, np.arange(len(ids))[:, None] < sizes[None, :], h)
        total = g if total is None else {k: x + g[k] for k, x in total.items()}
        n += int(sizes.sum())
        if n >= least:
            _update(adam, total, n)
            seen, n, total = seen + n, 0, None
        live = [(d, at + width) for d, at in live]
    if total is not None:
        _update(adam, total, n)
    return seen + n
