"""A linear-chain conditional random field over clauses, in numpy.

A clause has a few dense features and the ids of its known words. Scores are linear in both; neighbouring labels add a
transition score. Training maximises the conditional log-likelihood by Adam over mini-batches with forward-backward in log
space; decoding is Viterbi. Sequences of a batch are padded and advance together, so no loop runs over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Batch:
    """Clauses of n sequences, in order: sequence lengths, dense features, and (clause, word id) of known words."""

    lengths: np.ndarray
    dense: np.ndarray
    clause: np.ndarray
    word: np.ndarray


@dataclass
class Model:
    dense: np.ndarray
    word: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def emissions(self, b: Batch) -> np.ndarray:
        out = b.dense @ self.dense
        if len(b.clause):
            n = np.maximum(np.bincount(b.clause, minlength=len(out)), 1)
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(b.clause, self.word[b.word, k], len(out)) / np.sqrt(n)
        return out


def _padded(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), 1), values.shape[1]))
    out[row, col] = values
    return out, row, col


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(model: Model, b: Batch) -> np.ndarray:
    """The best label of every clause. Sequences are taken by falling length, so that short ones leave the work early."""
    out = np.zeros(len(b.dense), np.int8)
    if not len(out):
        return out
    score = model.emissions(b)
    first = np.cumsum(b.lengths) - b.lengths
    order = np.argsort(-b.lengths, kind="stable")
    lengths, first = b.lengths[order], first[order]
    live = int((lengths > 0).sum())
    best = score[first[:live]] + model.start
    back = []
    for t in range(1, int(lengths[0])):
        n = int((lengths > t).sum())
        paths = best[:n, :, None] + model.step[None]
        back.append(paths.argmax(1).astype(np.int8))
        best[:n] = paths.max(1) + score[first[:n] + t]
    label = best.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = int((lengths > t).sum())
        out[first[:n] + t] = label[:n]
        if t:
            label[:n] = back[t - 1][np.arange(n), label[:n]]
    return out


def train(b: Batch, labels: np.ndarray, n_labels: int, n_words: int, epochs: int = 14, size: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.01, (b.dense.shape[1], n_labels)), np.zeros((n_words, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels))]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    ends = np.cumsum(b.lengths)
    order, words = np.argsort(b.clause, kind="stable"), None
    clause, word = b.clause[order], b.word[order]
    t = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(b.lengths))
        for k in range(0, len(shuffled), size):
            seq = shuffled[k : k + size]
            seq = seq[b.lengths[seq] > 0]
            if not len(seq):
                continue
            rows = np.concatenate([np.arange(ends[s] - b.lengths[s], ends[s]) for s in seq])
            new = np.full(len(b.dense), -1, np.int64)
            new[rows] = np.arange(len(rows))
            words = new[clause] >= 0
            part = Batch(b.lengths[seq], b.dense[rows], new[clause[words]], word[words])
            model = Model(*p)
            score, row, col = _padded(model.emissions(part), part.lengths)
            y = labels[rows]
            n, steps, _ = score.shape
            on = np.arange(steps)[None, :] < part.lengths[:, None]
            fwd, bwd = np.zeros_like(score), np.zeros_like(score)
            fwd[:, 0] = score[:, 0] + model.start
            for j in range(1, steps):
                nxt = _lse(fwd[:, j - 1, :, None] + model.step[None], 1) + score[:, j]
                fwd[:, j] = np.where(on[:, j, None], nxt, fwd[:, j - 1])
            for j in range(steps - 2, -1, -1):
                prev = _lse(model.step[None] + (score[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
                bwd[:, j] = np.where(on[:, j + 1, None], prev, 0.0)
            z = _lse(fwd[:, -1], 1)
            mass = np.exp(fwd + bwd - z[:, None, None])
            grad = mass[row, col]
            grad[np.arange(len(rows)), y] -= 1
            pair = np.zeros_like(model.step)
            for j in range(1, steps):
                q = np.exp(fwd[:, j - 1, :, None] + model.step[None] + (score[:, j] + bwd[:, j])[:, None, :] - z[:, None, None])
                pair += q[on[:, j]].sum(0)
            inner = col > 0
            np.subtract.at(pair, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            g_word = np.zeros_like(p[1])
            count = np.maximum(np.bincount(part.clause, minlength=len(rows)), 1)
            np.add.at(g_word, part.word, grad[part.clause] / np.sqrt(count)[part.clause][:, None])
            gs = [part.dense.T @ grad, g_word, grad[col == 0].sum(0), pair]
            t += 1
            for i, g in enumerate(gs):
                g = g / len(seq) + decay * p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(*p)
