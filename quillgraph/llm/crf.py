"""A two-state linear-chain conditional random field over long word sequences (numpy, inside tasks).

With two states, the forward and the backward recursions are Moebius maps of one ratio. Sequences
are cut into columns of STEPS words; the maps of a column compose to one matrix, so all columns
run side by side and only column ends are walked one after the other. Results are exact.

For fitting, words without any feature need not be held: a run of them is a power of one matrix.
"""

from __future__ import annotations

import numpy as np

STEPS = 128


def moebius_scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]), from x = 1."""
    n = len(a)
    if not n:
        return np.zeros(0)
    columns = -(-n // STEPS)
    pad = columns * STEPS - n
    a, b, c, d = (np.concatenate([v, np.full(pad, w)]).reshape(columns, STEPS).T.copy() for v, w in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
    for t in range(STEPS):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    start, x = np.empty(columns), 1.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        start[k] = x
        x = (pk * x + qk) / (rk * x + sk)
    out = np.empty((STEPS, columns))
    for t in range(STEPS):
        start = (a[t] * start + b[t]) / (c[t] * start + d[t])
        out[t] = start
    return out.T.ravel()[:n]


class Chain:
    """weights: of features for state 1 (index 0 always holds); edges: log potentials of moves, by state from and to; first: log odds of a start."""

    def __init__(self, features: int):
        self.weights = np.zeros(features)
        self.weights[0] = -4.0
        self.edges = np.array([[0.0, -1.0], [-1.0, 0.0]])
        self.first = 0.0

    def odds(self, features: np.ndarray) -> np.ndarray:
        """exp of the score of state 1 at each word; features: indexes by word, 0 where there is none."""
        return np.exp(np.clip(self.weights[0] + (self.weights[features] * (features > 0)).sum(axis=1), -30, 30))

    def passes(self, odds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of the forward and the backward messages; starts marks each sequence's first word."""
        e = np.exp(self.edges)
        n = len(odds)
        a, b, c, d = e[1, 1] * odds, e[0, 1] * odds, np.full(n, e[1, 0]), np.full(n, e[0, 0])
        a[starts], b[starts], c[starts], d[starts] = 0.0, np.exp(self.first) * odds[starts], 0.0, 1.0
        forward = moebius_scan(a, b, c, d)
        after = np.r_[odds[1:], 1.0]
        a, b, c, d = e[1, 1] * after, np.full(n, e[1, 0]), e[0, 1] * after, np.full(n, e[0, 0])
        ends = np.r_[starts[1:], True]
        a[ends], b[ends], c[ends], d[ends] = 0.0, 1.0, 0.0, 1.0
        backward = moebius_scan(a[::-1], b[::-1], c[::-1], d[::-1])[::-1]
        return forward, backward

    def marginals(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of state 1 at each word."""
        forward, backward = self.passes(self.odds(features), starts)
        ratio = forward * backward
        return ratio / (1 + ratio)

    def fit(self, runs: "Runs", rounds: int = 60, decay: float = 0.02) -> None:
        """Climb the conditional likelihood of labelled words; step sizes follow the gradient's sign."""
        size = len(self.weights)
        values = np.r_[self.weights, self.edges[0, 1], self.edges[1, 0], self.edges[1, 1], self.first]
        step, before = np.full(len(values), 0.3), np.zeros(len(values))
        for _ in range(rounds):
            self.weights, self.first = values[:size], values[-1]
            self.edges = np.array([[0.0, values[size]], [values[size + 1], values[size + 2]]])
            gradient = runs.gradient(self) - decay * values
            turn = np.sign(gradient) * np.sign(before)
            step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-4, 1.0)
            before = np.where(turn < 0, 0.0, gradient)
            values = np.clip(values + np.sign(before) * step, -20, 20)


def _powers(matrix: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """matrix to each exponent, by squaring."""
    out = np.broadcast_to(np.eye(len(matrix)), (len(exponents), *matrix.shape)).copy()
    while exponents.any():
        odd = (exponents & 1).astype(bool)
        out[odd] = out[odd] @ matrix
        matrix, exponents = matrix @ matrix, exponents >> 1
    return out


class Runs:
    """Labelled sequences for fitting, each word without a feature only counted.

    A sequence is a list of steps: `gap` words without features, all of state 0, then one word with
    features and a state. The last step of a sequence has no word (featured False), only the gap
    that ends it. So the gradient costs as much as there are words with features.
    """

    def __init__(self, gaps: np.ndarray, features: np.ndarray, states: np.ndarray, lengths: np.ndarray):
        """gaps, features (a row a step, 0 for none), states: by step; lengths: steps of each sequence."""
        self.ends = np.zeros(len(gaps), dtype=bool)
        self.ends[np.cumsum(lengths) - 1] = True
        self.starts = np.r_[True, self.ends[:-1]]
        self.gaps, self.features, self.states = gaps, features, np.where(self.ends, 0, states)
        self.size, self.power = np.unique(gaps, return_inverse=True)
        word = np.repeat(np.arange(len(features)), features.shape[1])
        flat = features.ravel()
        self.word, self.flat = word[flat > 0], flat[flat > 0]

    @staticmethod
    def of(features: np.ndarray, starts: np.ndarray, states: np.ndarray) -> "Runs":
        """Of whole sequences, word by word; words without features must have state 0."""
        gaps, rows, marks, lengths = [], [], [], []
        heads = np.flatnonzero(starts)
        for lo, hi in zip(heads, np.r_[heads[1:], len(starts)], strict=True):
            places = np.flatnonzero(features[lo:hi].any(axis=1))
            gaps.append(np.diff(np.r_[-1, places, hi - lo]) - 1)
            rows += [features[lo + places], np.zeros((1, features.shape[1]), features.dtype)]
            marks.append(np.r_[states[lo + places], 0])
            lengths.append(len(places) + 1)
        return Runs(np.concatenate(gaps), np.concatenate(rows), np.concatenate(marks), np.array(lengths))

    def observed(self, size: int) -> np.ndarray:
        """Counts of the labels, by weights, edges 01, 10 and 11, and first."""
        out = np.zeros(size + 4)
        out[:size] = np.bincount(self.flat, weights=self.states[self.word], minlength=size)
        out[0] = self.states.sum()
        # the state before each featured word is 0 after a gap or at the start, else that of the word before
        before = np.where((self.gaps > 0) | self.starts, 0, np.r_[0, self.states[:-1]])
        led = ~(self.starts & (self.gaps == 0))  # a move leads to this word
        out[size] = ((before == 0) & (self.states == 1) & led).sum()
        out[size + 2] = ((before == 1) & (self.states == 1)).sum()
        left = np.r_[0, self.states[:-1]] * ~self.starts  # a toxic word stood before this step
        out[size + 1] = (left * np.where(self.gaps > 0, 1, (self.states == 0) & ~self.ends)).sum()
        out[-1] = (self.states * (self.starts & (self.gaps == 0))).sum()
        return out

    def gradient(self, chain: Chain) -> np.ndarray:
        """Of the log likelihood of whole sequences, in the order of observed()."""
        size, n = len(chain.weights), len(self.gaps)
        e, o = np.exp(chain.edges), np.exp(np.clip(chain.weights[0], -30, 30))
        word = np.where(self.ends, 1.0, chain.odds(self.features))

        # a word without features, and its change with bias and edges 01, 10, 11; scaled so that powers stay finite
        plain = e * np.array([1.0, o])
        slopes = np.zeros((4, 2, 2))
        slopes[0, :, 1] = plain[:, 1]
        slopes[1, 0, 1], slopes[2, 1, 0], slopes[3, 1, 1] = plain[0, 1], plain[1, 0], plain[1, 1]
        scale = np.abs(np.linalg.eigvals(plain)).max()
        plain, slopes = plain / scale, slopes / scale
        wide = [np.block([[plain, s], [np.zeros((2, 2)), plain]]) for s in slopes]

        def run(exponents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            powers = [_powers(w, exponents) for w in wide]
            return powers[0][:, :2, :2], np.stack([p[:, :2, 2:] for p in powers], axis=1)

        # from the state before a step (row) to that of its word (column); a start comes from state 0
        open_, open_slopes = run(self.size)
        step, change = open_[self.power], open_slopes[self.power]
        head = self.starts & (self.gaps > 0)
        if head.any():
            rest, rest_slopes = run(np.maximum(self.size - 1, 0))
            rest, rest_slopes = rest[self.power[head]], rest_slopes[self.power[head]]
            begin = np.array([[1.0, o * np.exp(chain.first)], [0.0, 0.0]]) / scale
            bias = np.array([[0.0, begin[0, 1]], [0.0, 0.0]])
            step[head] = begin @ rest
            change[head] = begin @ rest_slopes
            change[head, 0] += bias @ rest
            first_head = bias @ rest
        # then the featured word; none at the end of a sequence
        into = np.where(self.ends[:, None, None], np.eye(2), e * np.stack([np.ones(n), word], axis=1)[:, None, :])
        direct = self.starts & (self.gaps == 0) & ~self.ends
        into[direct] = 0.0
        into[direct, 0, 0], into[direct, 0, 1] = 1.0, np.exp(chain.first) * word[direct]
        full = step @ into
        d_full = change @ into[:, None]
        moves = ~self.ends & ~direct
        for p, (a, b) in enumerate(((0, 1), (1, 0), (1, 1)), 1):
            d_into = np.zeros((int(moves.sum()), 2, 2))
            d_into[:, a, b] = into[moves, a, b]
            d_full[moves, p] += step[moves] @ d_into
        d_first = np.zeros((n, 2, 2))
        d_first[direct, 0, 1] = into[direct, 0, 1]
        if head.any():
            d_first[head] = first_head @ into[head]

        # ratios of messages before (row vector) and after (column vector) each step
        m = full.copy()
        m[self.starts, 1, :] = m[self.starts, 0, :]  # a start forgets what stood before
        forward = moebius_scan(m[:, 1, 1], m[:, 0, 1], m[:, 1, 0], m[:, 0, 0])
        left = np.r_[0.0, forward[:-1]]
        left[self.starts] = 0.0
        b = full.copy()
        b[self.ends, :, 0] = full[self.ends].sum(axis=2)
        b[self.ends, :, 1] = 0.0
        back = moebius_scan(b[::-1, 1, 1], b[::-1, 1, 0], b[::-1, 0, 1], b[::-1, 0, 0])[::-1]
        right = np.r_[back[1:], 1.0]
        right[self.ends] = 1.0
        row, column = np.stack([np.ones(n), left], axis=1), np.stack([np.ones(n), right], axis=1)
        total = np.einsum("ni,nij,nj->n", row, full, column)
        p = full[:, :, 1].copy()
        p = np.where(self.ends, 0.0, (row * p).sum(axis=1) * right / total)

        expected = np.zeros(size + 4)
        expected[:size] = np.bincount(self.flat, weights=p[self.word], minlength=size)
        inner = np.einsum("ni,npij,nj->p", row / total[:, None], d_full, column)
        expected[0] = inner[0] + p.sum()
        expected[size : size + 3] = inner[1:]
        expected[-1] = (np.einsum("ni,nij,nj->n", row, d_first, column) / total).sum()
        return self.observed(size) - expected
