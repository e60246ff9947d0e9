"""A small causal self-attention model over subword ids, in numpy.

A token attends to itself and the tokens before it in its window (single head, learned bias by
distance), and a tanh layer gives the class of the next token; ids have a fixed share of their
class. Windows overlap: each has STRIDE queries and as many keys before them, and each token is
scored in one window. Gradients are written out; training is Adam over batches of windows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Queries of a window, keys of a window, width of embeddings, of keys, of the hidden layer, and classes.
STRIDE, SPAN, WIDTH, KEY, HIDDEN, CLASSES = 16, 32, 16, 8, 16, 32


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat place of each window's first query, queries that it has, and keys before them, for runs of these lengths laid end to end."""
    per = -(-lengths // STRIDE)
    run = np.repeat(np.arange(len(lengths)), per)
    within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    first = (np.cumsum(lengths) - lengths)[run] + within * STRIDE
    return first, np.minimum(STRIDE, lengths[run] - within * STRIDE), np.minimum(SPAN - STRIDE, within * STRIDE)


_GAP = (np.arange(STRIDE)[:, None] + SPAN - STRIDE) - np.arange(SPAN)[None, :]  # of query and key, in tokens
_CAUSAL = _GAP >= 0


@dataclass
class Attention:
    embed: np.ndarray  # ids x WIDTH
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    bias: np.ndarray  # by distance
    own: np.ndarray  # WIDTH x HIDDEN
    seen: np.ndarray  # WIDTH x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN x CLASSES
    out_bias: np.ndarray

    NAMES = ("embed", "query", "key", "value", "bias", "own", "seen", "hidden_bias", "out", "out_bias")

    @classmethod
    def fresh(cls, embed: np.ndarray, out_bias: np.ndarray, seed: int = 11) -> Attention:
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.normal(0, s[0] ** -0.5, s)).astype(np.float32)
        bias = (-0.15 * np.arange(SPAN)).astype(np.float32)
        return cls(embed.astype(np.float32), n(WIDTH, KEY), n(WIDTH, KEY), n(WIDTH, WIDTH), bias, n(WIDTH, HIDDEN), n(WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), 0.5 * n(HIDDEN, CLASSES), out_bias.astype(np.float32))

    def tables(self) -> dict[str, np.ndarray]:
        """Queries, keys, values and own parts of every id, for scoring."""
        return {"q": self.embed @ self.query * KEY**-0.5, "k": self.embed @ self.key, "v": self.embed @ self.value @ self.seen, "o": self.embed @ self.own + self.hidden_bias}

    def class_logs(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, tables: dict[str, np.ndarray], at_once: int = 2048) -> np.ndarray:
        """log P(class of the next token) at every place; ``inputs`` are ids, ``targets`` classes, laid end to end in runs."""
        found = np.zeros(len(inputs), np.float32)
        first, queries, before = windows(lengths)
        weight = np.where(_CAUSAL, np.exp(self.bias[np.clip(_GAP, 0, SPAN - 1)]), 0).astype(np.float32)
        for a in range(0, len(first), at_once):
            s, n, b = first[a : a + at_once], queries[a : a + at_once], before[a : a + at_once]
            place = s[:, None] + np.arange(-(SPAN - STRIDE), STRIDE)
            ids = inputs[np.clip(place, 0, len(inputs) - 1)]
            scores = tables["q"][ids[:, SPAN - STRIDE :]] @ tables["k"][ids].transpose(0, 2, 1)
            np.clip(scores, -60, 60, out=scores)  # the softmax is the same without its greatest taken off, and no sum overflows
            np.exp(scores, out=scores)
            scores *= weight
            scores[b == 0, :, : SPAN - STRIDE] = 0  # nothing comes before a run's first window
            h = scores @ tables["v"][ids]
            h /= scores.sum(2, keepdims=True)
            h += tables["o"][ids[:, SPAN - STRIDE :]]
            np.tanh(h, out=h)
            inside = np.arange(STRIDE) < n[:, None]
            rows, at = h[inside], place[:, SPAN - STRIDE :][inside]
            logits = rows @ self.out
            logits += self.out_bias
            picked = logits[np.arange(len(at)), targets[at]]
            np.exp(logits, out=logits)
            found[at] = picked - np.log(logits.sum(1))
        return found

    def loss_and_gradients(self, ids: np.ndarray, targets: np.ndarray, outside: np.ndarray, inside: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of a batch of windows; ids (n, SPAN), targets and inside (n, STRIDE), outside (n, SPAN)."""
        x = self.embed[ids]
        xq = x[:, SPAN - STRIDE :]
        q, k, v = xq @ self.query, x @ self.key, x @ self.value
        kind = self.bias.dtype.type  # all is in the weights' type
        s = q @ k.transpose(0, 2, 1)
        s *= kind(KEY**-0.5)
        s += np.where(_CAUSAL, self.bias[np.clip(_GAP, 0, SPAN - 1)], kind(-1e9))
        s += np.where(outside, kind(-1e9), kind(0))[:, None, :]
        p = np.exp(s - s.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        c = p @ v
        h = np.tanh(xq @ self.own + c @ self.seen + self.hidden_bias)
        logits = h @ self.out + self.out_bias
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        n, rows, columns = max(int(inside.sum()), 1), np.arange(len(ids))[:, None], np.arange(STRIDE)[None, :]
        loss = float(-(np.log(np.maximum(prob[rows, columns, targets], 1e-12)) * inside).sum() / n)
        d = prob
        d[rows, columns, targets] -= 1
        d *= (inside / n).astype(kind)[:, :, None]
        g = {"out": np.einsum("nth,ntc->hc", h, d, optimize=True), "out_bias": d.sum((0, 1))}
        dh = (d @ self.out.T) * (1 - h * h)
        g["own"], g["seen"], g["hidden_bias"] = np.einsum("ntw,nth->wh", xq, dh, optimize=True), np.einsum("ntw,nth->wh", c, dh, optimize=True), dh.sum((0, 1))
        dxq, dc = dh @ self.own.T, dh @ self.seen.T
        dv, dp = p.transpose(0, 2, 1) @ dc, dc @ v.transpose(0, 2, 1)
        ds = p * (dp - (dp * p).sum(2, keepdims=True))
        per_gap = np.bincount(np.clip(_GAP, 0, SPAN - 1)[_CAUSAL], weights=ds.sum(0)[_CAUSAL], minlength=SPAN)
        g["bias"] = per_gap.astype(np.float32)
        ds *= kind(KEY**-0.5)
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        g["query"], g["key"], g["value"] = np.einsum("ntw,ntk->wk", xq, dq, optimize=True), np.einsum("ntw,ntk->wk", x, dk, optimize=True), np.einsum("ntw,ntk->wk", x, dv, optimize=True)
        dx = dk @ self.key.T + dv @ self.value.T
        dx[:, SPAN - STRIDE :] += dxq + dq @ self.query.T
        g["embed"] = np.zeros_like(self.embed)
        flat, values = ids.ravel(), dx.reshape(-1, WIDTH)
        for w in range(WIDTH):
            g["embed"][:, w] = np.bincount(flat, weights=values[:, w], minlength=len(self.embed))
        return loss, g


class Adam:
    """Adam over batches of windows as they come; rows of the embedding move only when a batch has their ids."""

    def __init__(self, model: Attention, rate: float = 0.01):
        self.model, self.rate, self.steps = model, rate, 0
        self.first = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}
        self.second = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}

    def step(self, ids: np.ndarray, targets: np.ndarray, outside: np.ndarray, inside: np.ndarray) -> float:
        """One batch, as ``loss_and_gradients`` takes it; returns the loss."""
        self.steps += 1
        met, local = np.unique(ids, return_inverse=True)
        loss, g = replace(self.model, embed=self.model.embed[met]).loss_and_gradients(local.reshape(ids.shape), targets, outside, inside)
        rate = self.rate * min(1.0, self.steps / 20) / (1 + self.steps / 200) ** 0.5
        for k in self.model.NAMES:
            at = met if k == "embed" else slice(None)
            m, v = 0.9 * self.first[k][at] + 0.1 * g[k], 0.99 * self.second[k][at] + 0.01 * g[k] * g[k]
            self.first[k][at], self.second[k][at] = m, v
            getattr(self.model, k)[at] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)
        return loss
