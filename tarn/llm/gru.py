"""A gated recurrent language model over a small symbol set, in NumPy.

One GRU layer whose input weights are a row a symbol, and a class-factored
softmax: P(symbol) = P(class) * P(symbol | class). Training is truncated
backpropagation with Adam over windows in parallel lanes; scoring runs whole
documents in lanes, window after window, with the state carried on.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

HIDDEN = 16
#: Lanes, window and passes of training; lanes and window of scoring.
TRAIN_LANES, TRAIN_WINDOW, PASSES = 512, 16, 2
LANES, WINDOW = 128, 64
#: Tokens after which a long document goes on in another lane of training, with a fresh state.
TRAIN_PIECE = 1024
RATE = 4e-2
TRAINED = ("x", "u", "b", "wc", "bc", "ws", "bs")


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def lanes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt into lanes of about equal length, longest lane first: token numbers (-1: none) by step and lane, and where documents begin."""
    first = np.cumsum(sizes) - sizes
    n = max(1, min(most, len(sizes)))
    heap = [(0, k) for k in range(n)]
    own: list[list[int]] = [[] for _ in range(n)]
    total = np.zeros(n, np.int64)
    for d in np.argsort(-sizes, kind="stable"):
        size, k = heapq.heappop(heap)
        own[k].append(int(d))
        total[k] = size + sizes[d]
        heapq.heappush(heap, (int(total[k]), k))
    order = np.argsort(-total, kind="stable")
    index = np.full((int(total.max(initial=0)), n), -1, np.int32)
    start = np.zeros(index.shape, bool)
    for column, k in enumerate(order):
        at = 0
        for d in own[k]:
            index[at : at + sizes[d], column] = np.arange(first[d], first[d] + sizes[d])
            start[at, column] = True
            at += sizes[d]
    return index, start


@dataclass
class GRU:
    mass: np.ndarray  # how often each symbol stands in training; the last symbol is the end
    x: np.ndarray = field(init=False)  # input rows, (symbols, 3 * HIDDEN): update, reset, candidate
    u: np.ndarray = field(init=False)
    b: np.ndarray = field(init=False)  # candidate's recurrent bias
    wc: np.ndarray = field(init=False)
    bc: np.ndarray = field(init=False)
    ws: np.ndarray = field(init=False)  # (classes, members, HIDDEN)
    bs: np.ndarray = field(init=False)  # minus infinity where a class has no such member
    group: np.ndarray = field(init=False)
    member: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng(7)
        n, h = len(self.mass), HIDDEN
        size = max(1, int(np.ceil(np.sqrt(n))))
        groups = -(-n // size)
        place = np.empty(n, np.int64)
        place[np.argsort(-self.mass, kind="stable")] = np.arange(n)  # classes of like frequency
        self.group, self.member = place // size, place % size
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.x, self.u, self.b = f(n, 3 * h), f(h, 3 * h), np.zeros(h, np.float32)
        self.wc, self.ws = f(groups, h) * 0.1, f(groups, size, h) * 0.1
        mass = self.mass + 0.5
        by_group = np.bincount(self.group, mass, groups)
        self.bc = np.log(by_group / by_group.sum()).astype(np.float32)
        self.bs = np.full((groups, size), -np.inf, np.float32)
        self.bs[self.group, self.member] = np.log(mass / by_group[self.group])

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        u = h @ self.u
        gates = sigmoid(u[:, : 2 * HIDDEN] + x[:, : 2 * HIDDEN])
        n = u[:, 2 * HIDDEN :]
        n += self.b
        n *= gates[:, HIDDEN:]
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        h = h - n
        h *= gates[:, :HIDDEN]
        h += n
        return h

    def log_likelihood(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token of whole documents (each ends with the end symbol)."""
        out = np.zeros(len(symbols), np.float32)
        if not len(symbols):
            return out
        index, start = lanes(sizes, LANES)
        before = np.where(start, len(self.mass) - 1, symbols[np.maximum(np.concatenate((index[:1] * 0, index[:-1])), 0)])
        active = (index >= 0).sum(1)
        begins = start.any(1)
        state = np.zeros((index.shape[1], HIDDEN), np.float32)
        for a in range(0, len(index), WINDOW):
            b = min(a + WINDOW, len(index))
            width = active[a]
            x = self.x[before[a:b, :width]]
            seen = np.zeros((b - a, width, HIDDEN), np.float32)
            for t in range(a, b):
                k = active[t]
                h = state[:k]
                if begins[t]:
                    h[start[t, :k]] = 0
                state[:k] = seen[t - a, :k] = self.step(x[t - a, :k], h)
            at = index[a:b, :width]
            on = at >= 0
            out[at[on]] = self._log_softmax(seen[on], symbols[at[on]])
        return out

    def _tame(self) -> bool:
        """Whether no logit can be so large that its exponential needs the largest subtracted first; states are within 1."""
        own = np.where(np.isinf(self.bs), 0, self.bs)
        return bool(max((np.abs(self.wc).sum(1) + np.abs(self.bc)).max(), (np.abs(self.ws).sum(2) + np.abs(own)).max()) < 60)

    def _log_softmax(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        tame, group = self._tame(), self.group[target]

        def log_share(y, chosen):
            if not tame:
                y -= y.max(1, keepdims=True)
            own = y[np.arange(len(y)), chosen]
            np.exp(y, out=y)
            return own - np.log(y @ np.ones(y.shape[1], y.dtype))

        z = h @ self.wc.T
        z += self.bc
        out = log_share(z, group)
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(len(self.wc) + 1)).tolist()
        own, member, inside = h[order], self.member[target[order]], np.empty_like(out)
        for g in range(len(self.wc)):
            a, b = edge[g], edge[g + 1]
            if a < b:
                y = own[a:b] @ self.ws[g].T
                y += self.bs[g]
                inside[a:b] = log_share(y, member[a:b])
        out[order] += inside
        return out

    def weights(self) -> np.ndarray:
        """All trained parameters in one row; what no class has (minus infinity) is 0."""
        flat = np.concatenate([getattr(self, k).ravel() for k in TRAINED])
        flat[np.isinf(flat)] = 0
        return flat

    def load(self, flat: np.ndarray) -> None:
        """Parameters from such a row."""
        at = 0
        for k in TRAINED:
            a = getattr(self, k)
            new = flat[at : at + a.size].reshape(a.shape)
            a[...] = np.where(np.isinf(a), a, new)
            at += a.size

    def train(self, docs: list[np.ndarray], passes: int = PASSES, begin: float = 0.0, end: float = 1.0) -> None:
        """Truncated backpropagation over ``docs`` (symbols, the end symbol last), in the order given: the part from ``begin`` to ``end`` of a training whose rate falls throughout."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        symbols = np.concatenate(docs).astype(np.int64)
        fresh = np.zeros(len(symbols), bool)
        fresh[np.cumsum([0, *(len(d) for d in docs[:-1])])] = True
        index, start = lanes(np.array([min(TRAIN_PIECE, len(d) - a) for d in docs for a in range(0, len(d), TRAIN_PIECE)]), TRAIN_LANES)
        before = np.where(fresh[index], len(self.mass) - 1, symbols[index - 1])  # where there is no token it is not looked at
        first = {k: np.zeros_like(getattr(self, k)) for k in TRAINED}
        second = {k: np.zeros_like(getattr(self, k)) for k in TRAINED}
        n, windows = 0, range(0, len(index), TRAIN_WINDOW)
        for _ in range(passes):
            state = np.zeros((index.shape[1], HIDDEN), np.float32)
            for a in windows:
                b = min(a + TRAIN_WINDOW, len(index))
                width = int((index[a] >= 0).sum())  # the longest lanes come first
                grads, state = self._window(before[a:b, :width], start[a:b, :width], index[a:b, :width], symbols, state[:width])
                n += 1
                rate = RATE * (1 - 0.9 * (begin + (end - begin) * n / (passes * len(windows))))
                for k, g in grads.items():
                    m, v = first[k], second[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    getattr(self, k)[...] -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6)

    def _window(self, before, start, index, symbols, h0):
        """Gradients of a window's mean loss, and the state after it."""
        steps, width, hid = len(index), index.shape[1], HIDDEN
        x = self.x[before]
        kind = np.result_type(x, h0)
        hs, prev, n, inner = (np.zeros((steps, width, hid), kind) for _ in range(4))
        gates = np.zeros((steps, width, 2 * hid), kind)
        begins, keep = start.any(1).tolist(), ~start[:, :, None]
        h = h0
        for t in range(steps):
            prev[t] = np.where(start[t][:, None], np.float32(0), h) if begins[t] else h
            u = prev[t] @ self.u
            both = u[:, : 2 * hid]
            both += x[t, :, : 2 * hid]
            gates[t] = sigmoid(both)
            np.add(u[:, 2 * hid :], self.b, out=inner[t])
            c = inner[t] * gates[t, :, hid:]
            c += x[t, :, 2 * hid :]
            np.tanh(c, out=n[t])
            h = np.subtract(prev[t], n[t], out=hs[t])
            h *= gates[t, :, :hid]
            h += n[t]
        on = index >= 0
        y, target = hs[on], symbols[index[on]]
        dh_out, grads = self._softmax_grads(y, target)
        dhs = np.zeros_like(hs)
        dhs[on] = dh_out
        z, r = gates[:, :, :hid], gates[:, :, hid:]
        # what a step's gradient is multiplied by, for all steps at once
        to_n = (1 - z) * (1 - n * n)
        to_z = (prev - n) * z * (1 - z)
        to_r = to_n * inner * r * (1 - r)
        to_b = to_n * r
        factors = np.concatenate((to_z, to_r, to_b), 2).reshape(steps, width, 3, hid)
        back = np.zeros((steps, width, 3, hid), kind)
        across, dh = np.ascontiguousarray(self.u.T), np.zeros((width, hid), kind)
        for t in reversed(range(steps)):
            d = dhs[t]
            d += dh
            np.multiply(d[:, None, :], factors[t], out=back[t])
            dh = back[t].reshape(width, 3 * hid) @ across
            dh += d * z[t]
            if begins[t]:
                dh *= keep[t]
        flat = back.reshape(-1, 3 * hid)
        du, db = prev.reshape(-1, hid).T @ flat, flat[:, 2 * hid :].sum(0)
        dx = back.reshape(steps, width, 3 * hid)
        dx[:, :, 2 * hid :] = dhs * to_n
        gx = np.zeros_like(self.x)
        seen, own = before[on], dx[on]
        order = np.argsort(seen, kind="stable")
        edge = np.flatnonzero(np.diff(seen[order], prepend=-1))
        gx[seen[order[edge]]] = np.add.reduceat(own[order], edge)
        return grads | {"x": gx, "u": du, "b": db}, h

    def _softmax_grads(self, h, target):
        n, group, member = len(h), self.group[target], self.member[target]
        rows, tame = np.arange(n), self._tame()

        def shares(y):
            if not tame:
                y -= y.max(1, keepdims=True)
            np.exp(y, out=y)
            y /= (y @ np.ones(y.shape[1], y.dtype))[:, None]
            return y

        p = h @ self.wc.T
        p += self.bc
        p = shares(p)
        p[rows, group] -= 1
        p /= n
        dh = p @ self.wc
        ws, bs = np.zeros_like(self.ws), np.zeros_like(self.bs)
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(len(self.wc) + 1)).tolist()
        own, member = h[order], member[order]
        back = np.empty_like(own)
        for g in range(len(self.wc)):
            a, b = edge[g], edge[g + 1]
            if a < b:
                q = own[a:b] @ self.ws[g].T
                q += self.bs[g]
                q = shares(q)
                q[rows[: b - a], member[a:b]] -= 1
                q /= n
                back[a:b] = q @ self.ws[g]
                ws[g] = q.T @ own[a:b]
                bs[g] = q.sum(0)
        dh[order] += back
        bs[np.isinf(self.bs)] = 0
        return dh, {"wc": p.T @ h, "bc": p.sum(0), "ws": ws, "bs": bs}
