"""A small gated recurrent language model in numpy, with a class-factored softmax.

Documents run side by side in lanes.  They go in rounds: first the first piece of every document, then the second
of those that have one, from the state that the first has left, and so on; so lanes are full of pieces of like length
however long a document is, and its state is carried across windows and pieces to its end.  Units lie before lanes, so that
every operation runs over many lanes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, WINDOW, LANES, PIECE = 16, 16, 512, 512
NAMES = ("inputs", "state", "class_w", "class_b", "word_w", "word_b")
Lanes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sigmoid(x: np.ndarray) -> None:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> None:
    """In place, by one exponential, which is half of what numpy's takes."""
    x *= 2
    sigmoid(x)
    x *= 2
    x -= 1


def by_place(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of (unit, time, lane) rows of units at the places, all times and lanes one behind the other."""
    rows = np.ascontiguousarray(values.reshape(len(values), -1).T)
    return rows if len(at) == len(rows) else rows.take(at, axis=0)


def window(lanes: int) -> int:
    """Steps of a window: the fewer lanes, the longer, up to eight times ``WINDOW``, so that each has words enough."""
    return WINDOW * max(1, min(8, LANES // max(1, lanes)))


def rounds(docs: list[np.ndarray], piece: int = PIECE) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[int]]]:
    """Round by round the numbers of the documents that go on, their next pieces, and the id before each (0 at the beginning)."""
    numbers, lo = np.arange(len(docs)), 0
    while len(numbers):
        yield numbers, [docs[i][lo : lo + piece] for i in numbers], [int(docs[i][lo - 1]) if lo else 0 for i in numbers]
        lo += piece
        numbers = np.array([i for i in numbers if len(docs[i]) > lo], np.int64)


def in_lanes(docs: list[np.ndarray], before: list[int] | None = None, most: int = LANES) -> Lanes:
    """Inputs, targets, starts, numbers of the pieces as (time, lane) arrays, and how many lanes are still
    busy at each time (lanes go from the longest to the shortest)."""
    sizes = np.array([len(d) for d in docs])
    lanes = int(np.clip(sizes.sum() // max(1, sizes.max()), 8, most))
    loads, rows = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable"):
        k = int(np.argmin(loads))
        loads[k] += sizes[i]
        rows[k].append(i)
    order = np.argsort(-loads, kind="stable")
    steps = int(loads.max())
    x, y = np.zeros((steps, lanes), np.int32), np.zeros((steps, lanes), np.int32)
    start, own = np.zeros((steps, lanes), bool), np.zeros((steps, lanes), np.int32)
    for lane, k in enumerate(order):
        at = 0
        for i in rows[k]:
            d = docs[i]
            y[at : at + len(d), lane] = d
            x[at, lane] = before[i] if before else 0
            x[at + 1 : at + len(d), lane] = d[:-1]
            start[at, lane] = True
            own[at : at + len(d), lane] = i
            at += len(d)
    busy = (loads[order][None, :] > np.arange(steps)[:, None]).sum(axis=1)
    return x, y, start, own, busy


class Gru:
    """``words`` words with a softmax within their classes and ``tails`` classes of words outside it.

    Ids below ``words`` are words, frequent first, id 0 the end of a document; higher ids are tail
    classes.  ``counts`` has the frequency of every id; the model starts as the unigram model."""

    def __init__(self, counts: np.ndarray, words: int, classes: int = 24, seed: int = 5):
        self.words, rng = words, np.random.default_rng(seed)
        mass = np.cumsum(np.sqrt(counts[:words] + 1.0))
        self.of_word = np.minimum((mass / mass[-1] * classes).astype(np.int32), classes - 1)
        self.of_word = np.unique(self.of_word, return_inverse=True)[1].astype(np.int32)
        n = int(self.of_word.max()) + 1
        self.begin = np.searchsorted(self.of_word, np.arange(n + 1))
        tails = len(counts) - words
        self.class_of = np.concatenate([self.of_word, n + np.arange(tails, dtype=np.int32)])
        per_class = np.bincount(self.class_of, counts + 0.5, n + tails)
        h = HIDDEN
        self.inputs = rng.normal(0, 0.1, (len(counts), 3 * h)).astype(np.float32)
        self.state = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.class_w = np.zeros((h, n + tails), np.float32)
        self.class_b = np.log(per_class / per_class.sum()).astype(np.float32)
        self.word_w = np.zeros((words, h), np.float32)
        self.word_b = (np.log(counts[:words] + 0.5) - np.log(per_class[self.of_word])).astype(np.float32)

    def forward(self, x: np.ndarray, start: np.ndarray, own: np.ndarray, busy: np.ndarray, h: np.ndarray, carry: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (unit, time, lane) after every step of a window; ``h`` (unit, lane) is carried over in place.  A piece starts from its
        column of ``carry``, and leaves its last state there.  ``keep`` takes what the way back needs: previous states, both gates,
        new states and their recurrent part."""
        n, begins = HIDDEN, start.any(axis=1)
        out, weights = np.zeros((n, *x.shape), np.float32), np.ascontiguousarray(self.state.T)
        inputs = np.ascontiguousarray(self.inputs.T).take(x.ravel(), axis=1).reshape(3 * n, *x.shape)
        lasts = [*busy.tolist(), 0]
        for t, k in enumerate(lasts[:-1]):
            prev, u = h[:, :k].copy(), inputs[:, t, :k]
            if begins[t]:
                at = np.flatnonzero(start[t, :k])
                prev[:, at] = carry[:, own[t, at]]
            g = weights @ prev
            gates = g[: 2 * n] + u[: 2 * n]
            sigmoid(gates)
            z, r = gates[:n], gates[n:]
            new = r * g[2 * n :]
            new += u[2 * n :]
            tanh(new)
            now = out[:, t, :k]
            np.subtract(prev, new, out=now)
            now *= z
            now += new
            if keep is not None:
                keep.append((prev, z, r, new, g[2 * n :]))
            h[:, :k] = now
            if lasts[t + 1] < k or begins[t + 1]:
                ends = np.flatnonzero(start[t + 1, :k] | (np.arange(k) >= lasts[t + 1])) if t + 1 < len(x) else np.arange(k)
                carry[:, own[t, ends]] = now[:, ends]
        return out

    @staticmethod
    def _softmax(w: np.ndarray, b: np.ndarray, s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the scores (rows of ``w`` by rows of ``s``), and the log of the share that each y has."""
        z = w @ s.T
        z += b[:, None]
        z -= z.max(axis=0)
        own = z[y, np.arange(len(y))]
        np.exp(z, out=z)
        return z, own - np.log(z.sum(axis=0))

    def log_probs(self, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the class probability, times the word's within its class for words."""
        c = self.class_of[y]
        out = self._softmax(self.class_w.T, self.class_b, s, c)[1].astype(np.float64)
        for a, b, at in self._by_class(y, c):
            out[at] += self._softmax(self.word_w[a:b], self.word_b[a:b], s.take(at, axis=0), y[at] - a)[1]
        return out

    def _by_class(self, y: np.ndarray, c: np.ndarray):
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(len(self.begin)))
        for k in range(len(self.begin) - 1):
            a, b = self.begin[k], self.begin[k + 1]
            if edges[k] < edges[k + 1] and b - a > 1:
                yield a, b, order[edges[k] : edges[k + 1]]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each whole document (tail words: of their class)."""
        out, carry = np.zeros(len(docs)), np.zeros((HIDDEN, len(docs)), np.float32)
        for numbers, pieces, before in rounds(docs):
            x, y, start, own, busy = in_lanes(pieces, before)
            own, h, step = numbers[own], np.zeros((HIDDEN, x.shape[1]), np.float32), 4 * window(x.shape[1])
            for lo in range(0, len(x), step):
                cut = slice(lo, lo + step)
                s = self.forward(x[cut], start[cut], own[cut], busy[cut], h, carry)
                live = np.arange(x.shape[1])[None, :] < busy[cut, None]
                out += np.bincount(own[cut][live], self.log_probs(by_place(s, np.flatnonzero(live)), y[cut][live]), len(docs))
        return out

    def train(self, docs: list[np.ndarray], squares: dict[str, np.ndarray], rate: float = 0.1) -> None:
        """One pass of truncated backpropagation, a step of Adagrad after each window.  Gradients end with the
        window, states are carried on through each whole document."""
        carry = np.zeros((HIDDEN, len(docs)), np.float32)
        for numbers, pieces, before in rounds(docs):
            x, y, start, own, busy = in_lanes(pieces, before)
            own, h, step = numbers[own], np.zeros((HIDDEN, x.shape[1]), np.float32), window(x.shape[1])
            for lo in range(0, len(x), step):
                cut = slice(lo, lo + step)
                self._step(x[cut], y[cut], start[cut], own[cut], busy[cut], h, carry, squares, rate)

    def _descend(self, name: str, grad: np.ndarray, squares: dict, rate: float, at=slice(None)) -> None:
        squares[name][at] += grad * grad
        getattr(self, name)[at] -= rate * grad / np.sqrt(squares[name][at])

    def _step(self, x, y, start, own_docs, busy, h, carry, squares, rate) -> None:
        n, (steps, lanes), kept = HIDDEN, x.shape, []
        states = self.forward(x, start, own_docs, busy, h, carry, kept)
        live = np.flatnonzero(np.arange(lanes)[None, :] < busy[:, None])
        s, targets = by_place(states, live), y.ravel()[live]
        scale = np.float32(1 / len(targets))
        c, places = self.class_of[targets], np.arange(len(targets))
        p, _ = self._softmax(self.class_w.T, self.class_b, s, c)
        p *= scale / p.sum(axis=0)
        p[c, places] -= scale
        back = np.ascontiguousarray((self.class_w @ p).T)
        grads = [("class_w", (p @ s).T, slice(None)), ("class_b", p.sum(axis=1), slice(None))]
        for a, b, at in self._by_class(targets, c):
            own, mine = s.take(at, axis=0), targets[at] - a
            q, _ = self._softmax(self.word_w[a:b], self.word_b[a:b], own, mine)
            q *= scale / q.sum(axis=0)
            q[mine, places[: len(at)]] -= scale
            back[at] += q.T @ self.word_w[a:b]
            grads.append(("word_w", q @ own, slice(a, b)))
            grads.append(("word_b", q.sum(axis=1), slice(a, b)))
        full = back
        if len(live) < steps * lanes:
            full = np.zeros((steps * lanes, n), np.float32)
            full[live] = back
        full = np.ascontiguousarray(full.T).reshape(n, steps, lanes)
        before, of_inputs = np.zeros((n, steps, lanes), np.float32), np.zeros((3 * n, steps, lanes), np.float32)
        of_reset = np.zeros((n, steps, lanes), np.float32)
        dh, begins = np.zeros((n, lanes), np.float32), start.any(axis=1)
        for t in range(steps - 1, -1, -1):
            k = busy[t]
            prev, z, r, new, gn = kept[t]
            before[:, t, :k] = prev
            d = dh[:, :k] + full[:, t, :k]
            keeps, dg = d * z, np.empty((3 * n, k), np.float32)
            dn = d - keeps
            np.multiply(dn * (prev - new), z, out=dg[:n])
            dn *= 1 - new * new
            np.multiply(dn, r, out=dg[2 * n :])
            np.multiply(dg[2 * n :] * gn, 1 - r, out=dg[n : 2 * n])
            of_inputs[:, t, :k], of_reset[:, t, :k] = dg, dn
            keeps += self.state @ dg
            dh[:, :k] = keeps * ~start[t, :k] if begins[t] else keeps
        state_grad = before.reshape(n, -1) @ of_inputs.reshape(3 * n, -1).T
        of_inputs[2 * n :] = of_reset
        ids = x.ravel()  # idle lanes have id 0 and add nothing
        rows = np.flatnonzero(np.bincount(ids, minlength=len(self.inputs)))
        sums = np.stack([np.bincount(ids, of_unit, len(self.inputs))[rows] for of_unit in of_inputs.reshape(3 * n, -1)], 1)
        grads.append(("inputs", sums.astype(np.float32), rows))
        grads.append(("state", state_grad, slice(None)))
        for name, grad, at in grads:
            self._descend(name, grad, squares, rate, at)

    def fresh_squares(self) -> dict[str, np.ndarray]:
        return {name: np.full_like(getattr(self, name), 1e-6) for name in NAMES}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in NAMES])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for name in NAMES:
            old = getattr(self, name)
            setattr(self, name, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
