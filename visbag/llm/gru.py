"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output softmax.

Symbols: 0 ends a document, 1 .. K are frequent words, -1 .. -G the groups of other words. Outputs: a softmax over
classes of ``width`` symbols each and the G groups, then a softmax inside the class; what distinguishes the words of a
group is the caller's. Inputs: the symbol before (0 at the start), other words by their hashes (``tails``, as many as
groups, TAILS at least). Documents are laid out in streams that run in parallel; the state is carried from window to
window and cleared where a document starts. Scores carry it through the whole document; learning clears it after SEGMENT
tokens too, so that one very long document does not run alone.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, WIDTH, TAILS, WINDOW, STREAMS, STEP, RATE, BLOCK, SEGMENT, TOKENS, MANY = 24, 16, 8, 24, 512, 6000, 0.05, 256, 1024, 12_288, 16


def _sorted(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of ``keys`` from 0 to ``most`` (by counting, where 16 bits hold them)."""
    return np.argsort(keys.astype(np.uint16) if most < 1 << 16 else keys, kind="stable")


def _sums(rows: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``rows`` taken in ``order`` that begin at ``start``: long runs one by one, of the others all
    first rows, all second ones, and so on."""
    n = np.diff(start, append=len(order))
    out = rows.take(order[start], axis=0)
    many = np.flatnonzero(n > MANY)
    for k, a, b in zip(many.tolist(), start[many].tolist(), (start + n)[many].tolist()):
        out[k] = np.ones(b - a, np.float32) @ rows.take(order[a:b], axis=0)
    few, nth = np.flatnonzero((n > 1) & (n <= MANY)), 1
    while len(few):
        out[few] += rows.take(order[start[few] + nth], axis=0)
        nth += 1
        few = few[n[few] > nth]
    return out


class Model:
    def __init__(self, words: int, seed: int = 5, groups: int = 1, width: int = WIDTH):
        self.words, self.width, self.classes = words, width, -(-(words + 1) // width)
        outputs = self.classes + groups
        self.shapes = {"inputs": (words + 1 + max(TAILS, groups), 3 * HIDDEN), "gates": (HIDDEN, 2 * HIDDEN), "state": (HIDDEN, HIDDEN), "class_w": (HIDDEN, outputs), "class_b": (outputs,), "word_w": (self.classes, HIDDEN, width), "word_b": (self.classes, width)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        rng = np.random.default_rng(seed)
        flat = (rng.standard_normal(self.size) * 0.1).astype(np.float32)
        self.load(flat)
        self.word_b[:] = self.class_b[:] = 0
        over = np.arange(self.classes * width).reshape(self.classes, width) > words
        self.word_b[over] = -1e9  # places without a symbol
        self.used = None

    def begin_at(self, counts: np.ndarray, others: np.ndarray | int) -> None:
        """Starts from the frequencies of the symbols 0 .. K and of the groups of other words."""
        counts = np.asarray(counts, np.float64) + 1
        for c in range(self.classes):
            part = counts[c * self.width : (c + 1) * self.width]
            self.class_b[c], self.word_b[c, : len(part)] = np.log(part.sum()), np.log(part)
        self.class_b[self.classes :] = np.log(np.asarray(others) + 1)
        self.class_b -= self.class_b.max()

    def load(self, flat: np.ndarray) -> None:
        self.flat, at = np.array(flat, np.float32), 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    def step(self, x: np.ndarray, h: np.ndarray, out: np.ndarray):
        """The state after ``h``, into ``out``; gates, r h and the new part of the state."""
        a = self.inputs.take(x, axis=0)
        zr = h @ self.gates
        zr += a[:, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)  # the logistic function, by the tangent of the half
        zr *= 0.5
        zr += 0.5
        rh = zr[:, HIDDEN:] * h
        new = rh @ self.state
        new += a[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= zr[:, :HIDDEN]
        out += new
        return zr, rh, new

    @staticmethod
    def _shifted(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
        """``b`` less what its outputs cannot exceed, and whether this will do for every row."""
        most = np.abs(w).sum(0)  # the state is within -1 and 1
        high, low = float((b + most).max()), float(b.max() - most.max())
        return (b - np.float32(high), True) if high - low < 80 else (b, False)  # the largest of a row is no smaller than exp(-80)

    def _softmax(self, rows: np.ndarray, w: np.ndarray, shifted: tuple[np.ndarray, bool], chosen: np.ndarray, learn: tuple | None):
        """Natural log probabilities of ``chosen``; with ``learn`` (gradients of w and b) also the gradient of ``rows``."""
        e = rows @ w
        e += shifted[0]
        if not shifted[1]:
            e -= e.max(1, keepdims=True)
        k = np.arange(len(rows))
        log_p = e[k, chosen]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], np.float32)
        log_p -= np.log(total)
        if learn is None:
            return log_p, None
        e *= (1 / total)[:, None]
        e[k, chosen] -= 1
        learn[0][:] += rows.T @ e
        learn[1][:] += np.ones(len(e), np.float32) @ e
        return log_p, e @ w.T

    def _outputs(self, hs: np.ndarray, target: np.ndarray, learn: dict | None):
        """Natural log probabilities of ``target``; with ``learn``, its gradients too, and those of ``hs``. Rows are taken
        in the order of their classes, in blocks that stay in the processor's cache."""
        class_ = np.where(target < 0, self.classes - 1 - target, target // self.width)
        order = _sorted(class_, self.class_b.size)
        hs, class_, target = hs.take(order, axis=0), class_[order], target[order]
        log_p, dh = np.empty(len(hs), np.float32), np.empty_like(hs) if learn is not None else None
        grads = (learn["class_w"], learn["class_b"]) if learn is not None else None
        shifted = self._shifted(self.class_w, self.class_b)
        for a in range(0, len(hs), BLOCK):
            part = slice(a, a + BLOCK)
            log_p[part], d = self._softmax(hs[part], self.class_w, shifted, class_[part], grads)
            if learn is not None:
                dh[part] = d
        cuts = np.searchsorted(class_, np.arange(self.classes + 1)).tolist()
        for c in range(self.classes):
            if cuts[c] < cuts[c + 1]:
                shifted = self._shifted(self.word_w[c], self.word_b[c])
            for a in range(cuts[c], cuts[c + 1], BLOCK):
                part = slice(a, min(a + BLOCK, cuts[c + 1]))
                grads = (learn["word_w"][c], learn["word_b"][c]) if learn is not None else None
                more, d = self._softmax(hs[part], self.word_w[c], shifted, target[part] - c * self.width, grads)
                log_p[part] += more
                if learn is not None:
                    dh[part] += d
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return log_p[back], dh.take(back, axis=0) if learn is not None else None

    def window(self, x: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, grads: dict | None, valid: np.ndarray | None = None):
        """Runs the rows of ``x`` (steps x streams) from state ``h``: log probabilities, the last state, and gradients.
        Places that are not ``valid`` (streams that have ended) count for nothing."""
        steps, streams = x.shape
        there = slice(None) if valid is None or valid.all() else np.flatnonzero(valid)
        hs, cache = np.empty((steps, streams, HIDDEN), np.float32), []
        begins = fresh.any(1).tolist()
        for t in range(steps):
            if begins[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            before, h = h, hs[t]
            zr, rh, new = self.step(x[t], before, h)
            if grads is not None:
                cache.append((before, zr[:, :HIDDEN].copy(), zr[:, HIDDEN:].copy(), rh, new))
        log_p = np.zeros(steps * streams, np.float32)
        log_p[there], d_out = self._outputs(hs.reshape(-1, HIDDEN)[there], target.reshape(-1)[there], grads)
        if grads is not None:
            dh, later = np.zeros((steps * streams, HIDDEN), np.float32), np.zeros((streams, HIDDEN), np.float32)
            dh[there] = d_out
            dh = dh.reshape(steps, streams, HIDDEN)
            d_in = np.empty((steps, streams, 3 * HIDDEN), np.float32)
            for t in reversed(range(steps)):
                before, z, r, rh, new = cache[t]
                later += dh[t]
                d_new = later * (1 - z)
                d_new *= 1 - new * new
                d_rh = d_new @ self.state.T
                d_in[t, :, :HIDDEN] = later * (before - new) * z * (1 - z)
                d_in[t, :, HIDDEN : 2 * HIDDEN] = d_rh * before * r * (1 - r)
                d_in[t, :, 2 * HIDDEN :] = d_new
                later *= z
                later += d_rh * r
                later += d_in[t, :, : 2 * HIDDEN] @ self.gates.T
                grads["state"] += rh.T @ d_new
                grads["gates"] += before.T @ d_in[t, :, : 2 * HIDDEN]
                if begins[t]:
                    later *= ~fresh[t][:, None]
            flat, rows = x.reshape(-1), d_in.reshape(-1, 3 * HIDDEN)
            order = _sorted(flat, len(self.inputs))
            held = flat[order]
            start = np.flatnonzero(np.concatenate([[True], np.diff(held) != 0]))
            grads["inputs"][held[start]] += _sums(rows, order, start)
        return log_p.reshape(steps, streams), h.copy()

    def learn(self, symbols: np.ndarray, tails: np.ndarray, first: np.ndarray, rate: float = RATE) -> int:
        """One pass over the documents; adaptive step sizes. Returns the number of tokens."""
        if self.used is None:
            self.used = np.full(self.size, 1e-6, np.float32)
        flat, grads, at, seen = np.zeros(self.size, np.float32), {}, 0, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            grads[name] = flat[at : at + n].reshape(shape)
            at += n
        for x, target, fresh, _, h, valid in self._windows(symbols, tails, first, SEGMENT):
            _, h[0] = self.window(x, target, fresh, h[0], grads, valid)
            seen += int(valid.sum())
            if seen >= STEP:  # the last streams are few: their windows together make a step
                self._apply(flat, seen, rate)
                seen = 0
        if seen:  # what is left weighs by its tokens
            self._apply(flat, STEP, rate)
        return len(symbols)

    def _apply(self, flat: np.ndarray, tokens: int, rate: float) -> None:
        """A step along the gradient summed in ``flat``, which is cleared; in pieces that stay in the cache."""
        for a in range(0, self.size, 65536):
            g, used = flat[a : a + 65536], self.used[a : a + 65536]
            if not g.any():
                continue
            g *= np.float32(1 / tokens)
            used += g * g
            g /= np.sqrt(used)
            g *= np.float32(rate)
            self.flat[a : a + 65536] -= g
            g[:] = 0

    def log_probabilities(self, symbols: np.ndarray, tails: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log of each token's probability (other words: of their group)."""
        out = np.zeros(len(symbols))
        for x, target, fresh, at, h, valid in self._windows(symbols, tails, first):
            log_p, h[0] = self.window(x, target, fresh, h[0], None, valid)
            out[at[valid]] = log_p[valid]
        return out

    def _windows(self, symbols: np.ndarray, tails: np.ndarray, first: np.ndarray, segment: int | None = None):
        """Windows over streams of whole documents (or their segments), the longest streams first; h[0] holds their states.

        With segments (to learn) windows have WINDOW steps; without, more as fewer streams are left, TOKENS places in all."""
        before, lengths = np.empty(len(symbols), np.int64), np.diff(first)
        before[1:] = np.where(symbols[:-1] < 0, self.words + 1 + tails[:-1], symbols[:-1])
        before[first[:-1][lengths > 0]] = 0
        if segment is not None:
            parts = np.maximum(-(-lengths // segment), 1)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.append(np.repeat(first[:-1], parts) + nth * segment, first[-1])
            lengths = np.diff(first)
        docs = np.argsort(-lengths, kind="stable")
        docs = docs[lengths[docs] > 0]
        if not len(docs):
            return
        count = max(1, min(STREAMS, len(docs), int(len(symbols) // max(WINDOW, int(lengths.max()) // 4)) + 1))
        heap, streams = [(0, s) for s in range(count)], [[] for _ in range(count)]
        for d in docs.tolist():
            load, s = heapq.heappop(heap)
            streams[s].append(d)
            heapq.heappush(heap, (load + int(lengths[d]), s))
        new = np.zeros(len(symbols), bool)
        new[first[:-1][lengths > 0]] = True
        places = sorted((np.concatenate([np.arange(first[d], first[d + 1]) for d in s]) for s in streams), key=len, reverse=True)
        ends = np.array([len(p) for p in places])
        h, at = [np.zeros((count, HIDDEN), np.float32)], 0
        while at < ends[0]:
            active = int(np.searchsorted(-ends, -at, "left"))
            steps = int(min(WINDOW if segment is not None else max(WINDOW, TOKENS // active), ends[0] - at))
            step = at + np.arange(steps)[:, None]
            where, valid = np.zeros((steps, active), np.int64), step < ends[:active]
            for k, p in enumerate(places[:active]):
                own = p[at : at + steps]
                where[: len(own), k] = own
            h[0] = h[0][:active]
            yield before[where], symbols[where], new[where], where, h, valid
            at += steps
