"""Blocks of samples for the online learners: the states that :func:`millrace.operators.online.update` gives sample by sample, in far fewer passes over the centres.

Inner products of a block's samples with all centres and their ambiguities are matrix products, made once a block. Rules that move each centre along its own
line to the sample (``dro``, ``robust``, and no rule) then need numbers only: an ambiguity is kept as ``d u + e c + g X`` of its block until the block ends, its length and
its products by recurrences. The other rules need the moved centres as they are, sample by sample, and read them in pieces that stay in cache.
"""

from __future__ import annotations

import numpy as np

from .online import LEARNERS, Params, State, ambiguity_dro, ambiguity_mean, ambiguity_smooth, ambiguity_unit_before, update

#: samples of a block, and centres that are read at once
BLOCK, PIECE = 64, 1024


class _Block:
    """The centres of a state, with room for those that a block adds; places are taken from ``origin``, near which differences keep their digits."""

    def __init__(self, s: State, x: np.ndarray, y: np.ndarray, p: Params) -> None:
        self.s, self.p, self.n, self.plain, self.labels = s, p, len(s.l), x, y
        room, self.origin = self.n + len(x), (s.c if len(s.c) else x).mean(0)
        self.x = x - self.origin
        self.c, self.u = np.zeros((room, x.shape[1])), np.zeros((room, x.shape[1]))
        self.c[: self.n], self.u[: self.n] = s.c - self.origin, s.u
        self.l, self.w, self.alpha, self.grad = (np.concatenate([v, np.zeros(len(x))]) for v in (s.l, s.w, s.alpha, s.grad))
        self.xx, self.cc = self.x @ self.x.T, np.zeros(room)
        self.cc[: self.n] = np.einsum("ij,ij->i", self.c[: self.n], self.c[: self.n])
        self.cx = np.zeros((room, len(x)), order="F")
        self.cx[: self.n] = self.c[: self.n] @ self.x.T
        self.born: list[int] = []

    def _exact(self, i: int, t: int) -> bool:
        c = self.s.c[i] if i < len(self.s.l) else self.plain[self.born[i - len(self.s.l)]]
        return bool(np.sqrt(((c - self.plain[t]) ** 2).sum()) < self.p.radius)

    def cover(self, t: int) -> np.ndarray:
        """The sample shares a weight or becomes a centre; the squared distances of all centres to it. Those on the edge of the radius are measured by themselves."""
        n, y, square = self.n, self.labels[t], self.p.radius**2
        gap = np.maximum(self.cc[:n] + self.xx[t, t] - 2 * self.cx[:n, t], 0.0)
        if self.p.radius > 0:
            near = (gap < square) & (self.l[:n] == y)
            edge = np.flatnonzero((np.abs(gap - square) <= 1e-12 * (self.cc[:n] + self.xx[t, t] + square)) & (self.l[:n] == y))
            for i in edge:
                near[i] = self._exact(i, t)
            count = np.count_nonzero(near)
            if count:
                self.w[:n][near] += 1 / count
                return gap
        self.c[n], self.cc[n], self.cx[n] = self.x[t], self.xx[t, t], self.xx[t]
        self.l[n], self.w[n] = y, 1.0
        self.born.append(t)
        self.n += 1
        return np.append(gap, 0.0)

    def hinge(self, k: np.ndarray, y: float, weights: bool, weighted: bool, signed: bool) -> None:
        n, p = self.n, self.p
        l, w = self.l[:n], self.w[:n]
        share = k * l
        if weights:
            share = share * w
        if y * (share @ self.alpha[:n]) < 1:
            self.grad[:n] -= (y * share) if weights else (y * w * share)
            alpha = np.minimum(np.exp(-p.eta * self.grad[:n] - 1), p.C)
            part = alpha * w if weighted else alpha
            total = (part @ l) if signed else part.sum()
            out = alpha.copy()
            for label in (1.0, -1.0):
                own = l == label
                mass = part @ own
                if mass > 0:
                    np.multiply(part if weighted and not signed else alpha, total / 2 / mass, out=out, where=own)
            self.alpha[:n] = out

    def store(self, u: np.ndarray) -> None:
        s, n = self.s, self.n
        s.c = np.vstack([s.c, self.plain[self.born]])
        s.u = u
        s.l, s.w, s.alpha, s.grad = (v[:n].copy() for v in (self.l, self.w, self.alpha, self.grad))


def _by_numbers(s: State, x: np.ndarray, y: np.ndarray, p: Params, learner: str) -> None:
    """Rules that change an ambiguity u of centre c by ``(1 - b / w) u + b (c - x)`` and a scale."""
    rule, weights, weighted, signed = LEARNERS[learner]
    rule, held = rule if p.eps > 0 else None, _Block(s, x, y, p)
    any_u, two = rule is not None or bool(s.u.any()), 2 * p.sigma * p.sigma
    room = len(held.l)
    if any_u:
        start = held.u[: held.n]
        first = np.zeros((room, len(x)), order="F")
        first[: held.n] = start @ held.x.T
        uu, uc = np.zeros(room), np.zeros(room)
        uu[: held.n], uc[: held.n] = np.einsum("ij,ij->i", start, start), np.einsum("ij,ij->i", start, held.c[: held.n])
        d, e, g = np.ones(room), np.zeros(room), np.zeros((room, len(x)), order="F")
    for t, label in enumerate(y):
        gap = held.cover(t)
        n = held.n
        w = held.w[:n]
        if any_u:
            cx, xx = held.cx[:n, t], held.xx[t, t]
            ux = d[:n] * first[:n, t] + e[:n] * cx + g[:n, :t] @ held.xx[:t, t]
            k = np.exp(-np.maximum(gap - 2 * (uc[:n] - ux) / w + uu[:n] / (w * w), 0.0) / two)
        else:
            k = np.exp(-gap / two)
        if rule is not None:
            b = held.alpha[:n] * k / p.sigma**2
            b = b * held.l[:n] * (-p.eta * label) if rule is ambiguity_dro else b * (held.l[:n] != label)
            keep = 1 - b / w
            size = np.maximum(keep * keep * uu[:n] + b * b * gap + 2 * keep * b * (uc[:n] - ux), 0.0)
            length = np.sqrt(size)
            if rule is ambiguity_dro:
                scale = np.minimum(1.0, p.eps / np.maximum(length, 1e-300))
            else:
                mean = length.mean()
                scale = p.eps / mean if mean > p.eps else 1.0
            keep, b = keep * scale, b * scale
            uu[:n], uc[:n], ux = size * scale * scale, keep * uc[:n] + b * (held.cc[:n] - cx), keep * ux + b * (cx - xx)
            d[:n] *= keep
            e[:n] = keep * e[:n] + b
            g[:n, :t] *= keep[:, None]
            g[:n, t] = -b
            k = np.exp(-np.maximum(gap - 2 * (uc[:n] - ux) / w + uu[:n] / (w * w), 0.0) / two)
        held.hinge(k, label, weights, weighted, signed)
    n = held.n
    held.store(d[:n, None] * held.u[:n] + e[:n, None] * held.c[:n] + g[:n] @ held.x if rule is not None else held.u[:n].copy())


def _pieces(rows: np.ndarray):
    return (rows[i : i + PIECE] for i in range(0, len(rows), PIECE))


def _by_places(s: State, x: np.ndarray, y: np.ndarray, p: Params, learner: str) -> None:
    """Rules that need the moved centres themselves. The ambiguities are ``scale`` times ``u``: a bound on their mean length changes that number alone."""
    rule, weights, weighted, signed = LEARNERS[learner]
    held, two, scale = _Block(s, x, y, p), 2 * p.sigma * p.sigma, 1.0
    c, u, size = held.c, held.u, np.zeros(len(held.l))
    size[: held.n] = np.einsum("ij,ij->i", u[: held.n], u[: held.n])
    seen, known = (np.vstack([s.rx, x]), np.append(s.ry, y)) if rule is ambiguity_smooth else (None, None)
    pulls = np.empty_like(c)
    for t, label in enumerate(y):
        gap = held.cover(t)
        n, v = held.n, held.x[t]
        l, w, alpha = held.l[:n], held.w[:n], held.alpha[:n]
        if rule is ambiguity_smooth:
            upto = len(seen) - len(x) + t + 1
            z, marks = seen[:upto][-p.window :] - held.origin, known[:upto][-p.window :]
            k = np.empty(n)
            for value in np.unique(l):
                ends = np.vstack([z[value * marks == -1], v])
                reach = np.einsum("ij,ij->i", ends, ends)
                for rows in _pieces(np.flatnonzero(l == value)):
                    own = u[rows]
                    at = c[rows] - own * (scale / w[rows])[:, None]
                    near = np.exp(-np.maximum(np.einsum("ij,ij->i", at, at)[:, None] + reach - 2 * at @ ends.T, 0.0) / two)
                    k[rows], near = near[:, -1], near[:, :-1]
                    own -= (p.eta / scale * alpha[rows])[:, None] * (near @ ends[:-1] - near.sum(1)[:, None] * at)
                    u[rows], size[rows] = own, np.einsum("ij,ij->i", own, own)
            moves = True
        else:
            others, k, found = np.flatnonzero(l != label), np.zeros(n), 0
            gram = np.zeros((len(v), len(v)))
            for rows in _pieces(others):
                gaps = v - c[rows] + u[rows] * (scale / w[rows])[:, None]
                k[rows] = near = np.exp(-np.einsum("ij,ij->i", gaps, gaps) / two)
                pull = pulls[found : found + len(rows)]
                np.multiply(gaps, (alpha[rows] * near / p.sigma**2)[:, None], out=pull)
                gram += pull.T @ pull
                found += len(rows)
            # the largest singular value of all pulls, from their Gram matrix
            norm = np.sqrt(max(np.linalg.eigvalsh(gram)[-1], 0.0)) if found else 0.0
            moves = norm > 0.01
            if moves:
                found = 0
                for rows in _pieces(others):
                    own = u[rows]
                    own -= pulls[found : found + len(rows)] * (p.eta / norm / scale)
                    u[rows], size[rows] = own, np.einsum("ij,ij->i", own, own)
                    found += len(rows)
        if moves:
            mean = scale * np.sqrt(size[:n]).mean()
            if mean > p.eps:
                scale *= p.eps / mean
            if scale < 1e-100:
                u *= scale
                size *= scale * scale
                scale = 1.0
        if rule is not ambiguity_smooth and rule is not ambiguity_unit_before:
            along = np.einsum("ij,ij->i", u[:n], c[:n]) - u[:n] @ v
            k = np.exp(-np.maximum(gap - 2 * scale * along / w + scale * scale * size[:n] / (w * w), 0.0) / two)
        held.hinge(k, label, weights, weighted, signed)
    held.store(u[: held.n] * scale)


def learn(s: State, x: np.ndarray, y: np.ndarray, p: Params, learner: str) -> None:
    """All samples, in their order. Components that are not finite go one by one, as do samples of no components."""
    rule = LEARNERS[learner][0] if p.eps > 0 else None
    if not x.size or not all(np.isfinite(v).all() for v in (x, y, s.c, s.u, s.rx)):
        for v, label in zip(x, y):
            update(s, v, label, p, learner)
        return
    numbers = rule is None or rule in (ambiguity_dro, ambiguity_mean)
    (_by_numbers if numbers else _by_places)(s, x, y, p, learner)
    if LEARNERS[learner][0] is ambiguity_smooth:
        s.rx, s.ry = np.vstack([s.rx, x])[-p.window :], np.append(s.ry, y)[-p.window :]
