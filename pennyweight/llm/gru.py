"""A small gated recurrent language model in numpy with a class-factored softmax.

Inputs and targets are numbers below ``n_words + n_rest``: head words come
first, ``per_class`` to a class; each further number is a class of rare
words on its own, within which probabilities are fixed outside the model.
So ``P(word) = P(class | state) * P(word | class, state)`` for head words,
and the second factor is left to the caller for the rest.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
WINDOW = 32
#: Rows of the softmax at once, which stay in a core's cache.
ROWS = 512


class Model:
    """Parameters by name; all are float32 arrays."""

    def __init__(self, n_words: int, per_class: int, n_rest: int, hidden: int = 32, bias: np.ndarray | None = None, seed: int = 7):
        self.n_words, self.per_class, self.n_rest, self.hidden = n_words, per_class, n_rest, hidden
        self.heads = n_words // per_class
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.1).astype(F32)
        self.p = {
            "x": draw(n_words + n_rest, 3 * hidden),
            "u": draw(hidden, 2 * hidden),
            "v": draw(hidden, hidden),
            "b": np.concatenate([np.ones(hidden), np.zeros(2 * hidden)]).astype(F32),
            "c": draw(hidden, self.heads + n_rest),
            "cb": np.zeros(self.heads + n_rest, F32),
            "w": draw(self.heads, hidden, per_class),
            "wb": np.zeros((self.heads, per_class), F32),
        }
        if bias is not None:  # logarithms of the tokens' counts
            self.p["wb"] = bias[:n_words].reshape(self.heads, per_class).astype(F32)
            mass = np.exp(bias)
            self.p["cb"] = np.log(np.concatenate([mass[:n_words].reshape(self.heads, per_class).sum(1), mass[n_words:]]) + 1e-9).astype(F32)
            self.p["cb"] -= self.p["cb"].max()
            self.p["wb"] -= self.p["wb"].max(axis=1, keepdims=True)

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for name, value in self.p.items():
            self.p[name] = flat[at : at + value.size].reshape(value.shape).astype(F32)
            at += value.size
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_words, ids // self.per_class, self.heads + ids - self.n_words)

    def step(self, ids: np.ndarray, h: np.ndarray, x: np.ndarray | None = None, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next state (in ``out``), and both gates and the proposal; ``x`` may hold what the words ``ids`` add, bias included."""
        n, p = self.hidden, self.p
        if x is None:
            x = p["x"][ids] + p["b"]
        zr = h @ p["u"]
        zr += x[:, : 2 * n]
        np.negative(zr, out=zr)
        with np.errstate(over="ignore"):  # a gate of an endless term is 0
            np.exp(zr, out=zr)
        zr += F32(1)
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :n], zr[:, n:]
        new = (r * h) @ p["v"]
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        out = np.subtract(h, new, out=out)
        out *= z
        out += new
        return out, z, r, new

    def outputs(self, states: np.ndarray, targets: np.ndarray, learn: bool = False, full: int = 1):
        """Natural log probabilities; with ``learn``, gradients too, of the mean loss over ``full`` places if they are fewer."""
        p, count = self.p, len(targets)
        classes = self.class_of(targets)
        logp = np.empty(count, states.dtype)
        grads, dh, scale = {}, None, F32(1 / max(full, count))
        if learn:
            dh = np.empty_like(states)
            grads = {k: np.zeros_like(p[k]) for k in ("c", "cb", "w", "wb")}
        for at in range(0, count, ROWS):
            here, mine = states[at : at + ROWS], classes[at : at + ROWS]
            logits = here @ p["c"]
            logits += p["cb"]
            logp[at : at + ROWS], total = _softmax(logits, mine)
            if learn:
                logits *= (scale / total)[:, None]
                logits[np.arange(len(mine)), mine] -= scale
                grads["c"] += here.T @ logits
                grads["cb"] += _ones(len(mine), logits.dtype) @ logits
                np.matmul(logits, p["c"].T, out=dh[at : at + ROWS])
        # numbers of 16 bits sort by counting
        order = np.argsort(classes.astype(np.int16) if self.heads + self.n_rest < 1 << 15 else classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(self.heads + 1))
        order = order[: cuts[-1]]
        sorted_states, words = states[order], targets[order]
        some = np.empty(len(order), states.dtype)
        back = np.empty_like(sorted_states) if learn else None
        for k in range(self.heads):
            part = slice(cuts[k], cuts[k + 1])
            mine, word = sorted_states[part], words[part] - k * self.per_class
            if not len(mine):
                continue
            inner = mine @ p["w"][k]
            inner += p["wb"][k]
            some[part], total = _softmax(inner, word)
            if learn:
                inner *= (scale / total)[:, None]
                inner[np.arange(len(mine)), word] -= scale
                grads["w"][k], grads["wb"][k] = mine.T @ inner, _ones(len(mine), inner.dtype) @ inner
                np.matmul(inner, p["w"][k].T, out=back[part])
        logp[order] += some
        if learn:
            dh[order] += back
        return logp, grads, dh


def _ones(n: int, kind: np.dtype) -> np.ndarray:
    return np.ones(n, kind)


def _softmax(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares at one column of each row, and each row's sum; ``logits`` become the terms of the sums.

    Rows are lowered by their greatest value only where a term could leave the range of 32 bits.
    """
    if logits.size and not -80 < logits.min() <= logits.max() < 80:
        logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ _ones(logits.shape[1], logits.dtype)
    chosen -= np.log(total)
    return chosen, total


class Trainer:
    """Adagrad over windows of truncated back-propagation; one of fewer than ``full`` places teaches that much less."""

    def __init__(self, model: Model, rate: float = 0.1, full: int = 1):
        self.model, self.rate, self.full = model, F32(rate), full
        self.seen = {k: np.full_like(v, 1e-8) for k, v in model.p.items()}

    def window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, starts: np.ndarray | None = None, inside: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """One update on (time, batch) windows that start from states ``h``; the states after it and the mean loss.

        Where ``starts`` is true a new sequence begins: the state is zero
        there, and nothing is learnt across it.  Where ``inside`` is false a
        sequence has ended: such places neither count nor teach.
        """
        m, n = self.model, self.model.hidden
        steps, batch = inputs.shape
        x = np.take(m.p["x"] + m.p["b"], inputs, axis=0)
        kept, old, states = [], np.empty((steps, batch, n), x.dtype), np.empty((steps, batch, n), x.dtype)
        resets = np.zeros(steps, bool) if starts is None else starts.any(axis=1)
        for t, ids in enumerate(inputs):
            old[t] = h
            if resets[t]:
                old[t][starts[t]] = 0
            h, *gates = m.step(ids, old[t], x[t], states[t])
            kept.append(gates)
        states, targets = states.reshape(-1, n), targets.ravel()
        if inside is None or inside.all():
            logp, grads, dout = m.outputs(states, targets, True, self.full)
        else:
            at = np.flatnonzero(inside)
            logp, grads, some = m.outputs(states[at], targets[at], True, self.full)
            dout = np.zeros((steps * batch, n), F32)
            dout[at] = some
        dout = dout.reshape(steps, batch, n)
        u, v = m.p["u"].T.copy(), m.p["v"].T.copy()
        dx, reset = x, np.empty((steps, batch, n), x.dtype)  # what the words added is used up
        back = np.zeros((batch, n), F32)
        for t in range(steps - 1, -1, -1):
            z, r, new = kept[t]
            dh = dout[t]
            dh += back
            np.multiply(r, old[t], out=reset[t])
            left, here = F32(1) - z, dx[t]
            new2 = new * new
            np.subtract(F32(1), new2, out=new2)
            new2 *= left
            dnew = np.multiply(new2, dh, out=here[:, 2 * n :])
            drh = dnew @ v
            # r (1 - r) times the old state, and z (1 - z) times what z weighs
            left *= z
            left *= np.subtract(old[t], new, out=new)
            np.multiply(left, dh, out=here[:, :n])
            dr = r * reset[t]
            np.subtract(reset[t], dr, out=dr)
            np.multiply(dr, drh, out=here[:, n : 2 * n])
            back = here[:, : 2 * n] @ u
            dh *= z
            back += dh
            drh *= r
            back += drh
            if resets[t]:
                back[starts[t]] = 0
        flat = dx.reshape(-1, 3 * n)
        grads["u"] = old.reshape(-1, n).T @ flat[:, : 2 * n]
        grads["v"] = reset.reshape(-1, n).T @ flat[:, 2 * n :]
        grads["b"] = _ones(len(flat), flat.dtype) @ flat
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.int16) if len(m.p["x"]) < 1 << 15 else ids, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        rows, sums = ids[order][at], _sums(np.take(flat, order, axis=0), at)
        self.seen["x"][rows] += sums * sums
        m.p["x"][rows] -= self.rate * sums / np.sqrt(self.seen["x"][rows])
        for k, g in grads.items():
            self.seen[k] += g * g
            m.p[k] -= self.rate * g / np.sqrt(self.seen[k])
        return h, float(-logp.mean())


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the groups of ``rows`` that begin ``at``; two numbers at once, as complex ones, if columns are even."""
    if rows.shape[1] % 2:
        return np.add.reduceat(rows, at, axis=0)
    pairs = rows.view(np.result_type(rows, np.complex64))
    return np.add.reduceat(pairs, at, axis=0).view(rows.dtype)


def log_likelihood(model: Model, sequences: list[np.ndarray], start: int, cells: int = 1 << 14, lanes: int = 512) -> np.ndarray:
    """The natural log probability of each whole sequence, state carried from window to window.

    ``lanes`` sequences of like length run side by side, longest first, so those at work are always a prefix.
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-sizes, kind="stable")
    words, out = model.p["x"] + model.p["b"], np.zeros(len(order))
    for at in range(0, len(order), lanes):
        some = order[at : at + lanes]
        out[some] = _side_by_side(model, words, [sequences[k] for k in some], sizes[some], start, cells)
    return out


def _side_by_side(model: Model, words: np.ndarray, sequences: list[np.ndarray], lengths: np.ndarray, start: int, cells: int) -> np.ndarray:
    """The log probabilities of sequences whose ``lengths`` descend; ``words``: what words add, bias included."""
    flat, begins = np.concatenate(sequences), np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    out, h, last = np.zeros(len(lengths)), np.zeros((len(lengths), model.hidden), F32), np.full(len(lengths), start)
    t = 0
    while t < len(active):
        now = active[t : t + min(256, max(1, cells // active[t]))]
        cuts = np.r_[0, np.cumsum(now)]
        owners = np.arange(cuts[-1]) - np.repeat(cuts[:-1], now)
        targets = flat[begins[owners] + np.repeat(np.arange(t, t + len(now)), now)]
        states = np.empty((len(targets), model.hidden), F32)
        for n, a, b in zip(now.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            h, *_ = model.step(last, h[:n], np.take(words, last[:n], axis=0), states[a:b])
            last = targets[a:b]
        logp, *_ = model.outputs(states, targets)
        out += np.bincount(owners, weights=logp, minlength=len(out))
        t += len(now)
    return out
