"""A gated recurrent language model in numpy: one layer, class-factored output, truncated backpropagation.

Token numbers: ``0 .. n_head - 1`` are frequent words (0 ends a text), further numbers are classes of
all other words. The output first chooses a class: the head words are in classes of
``HEAD_CLASS`` by frequency, with a softmax of their own that depends on the state; every number
from ``n_head`` on is a class by itself, whose words are told apart outside of this module.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

STATE = 24
INPUT = 16
HEAD_CLASS = 32
CHUNK = 16
END = 0


@dataclass(frozen=True)
class Shape:
    """How many head words (a multiple of the class size) and how many classes of other words there are."""

    n_head: int
    n_tail: int

    @property
    def n_groups(self) -> int:
        return self.n_head // HEAD_CLASS

    @property
    def sizes(self) -> dict[str, tuple[int, ...]]:
        n, c, g = self.n_head + self.n_tail, self.n_groups + self.n_tail, self.n_groups
        return {
            "embed": (n, INPUT), "wx": (INPUT, 3 * STATE), "wh": (STATE, 3 * STATE), "b": (3 * STATE,), "wc": (STATE, c), "bc": (c,),
            "ww": (g, STATE, HEAD_CLASS), "bw": (g, HEAD_CLASS),
        }

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters as named views of one vector."""
        out, at = {}, 0
        for name, size in self.sizes.items():
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        return out

    @property
    def length(self) -> int:
        return sum(int(np.prod(s)) for s in self.sizes.values())

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens < self.n_head, tokens // HEAD_CLASS, tokens - self.n_head + self.n_groups)


def initial(shape: Shape, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Parameters that give each token its share of ``counts`` whatever the state is."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.length, np.float32)
    p = shape.views(flat)
    p["embed"][:] = rng.normal(0, 0.3, p["embed"].shape)
    p["wx"][:] = rng.normal(0, INPUT**-0.5, p["wx"].shape)
    p["wh"][:] = rng.normal(0, STATE**-0.5, p["wh"].shape)
    p["b"][:STATE] = 1.0  # keep the state at first
    p["wc"][:] = rng.normal(0, 0.02, p["wc"].shape)
    p["ww"][:] = rng.normal(0, 0.02, p["ww"].shape)
    words = counts.astype(np.float64) + 0.5
    head = words[: shape.n_head].reshape(shape.n_groups, HEAD_CLASS)
    p["bw"][:] = np.log(head / head.sum(axis=1, keepdims=True))
    classes = np.concatenate([head.sum(axis=1), words[shape.n_head :]])
    p["bc"][:] = np.log(classes / classes.sum())
    return flat


class Scorer:
    """Log-likelihoods of whole texts; the state goes on from window to window. Arrays are made once, for all windows."""

    def __init__(self, shape: Shape, flat: np.ndarray, window: int = 16, batch: int = 512, rows: int = 512) -> None:
        self.shape, self.p, self.window, self.batch, self.rows = shape, shape.views(flat), window, batch, rows
        inputs, wh, gates = self.p["embed"] @ self.p["wx"] + self.p["b"], self.p["wh"], 2 * STATE
        # gates and candidates in arrays of their own: whole rows are faster than slices of rows
        self.to_gates, self.to_new = inputs[:, :gates].copy(), inputs[:, gates:].copy()
        self.wh_gates, self.wh_new = wh[:, :gates].copy(), wh[:, gates:].copy()
        self.to_gates *= -1  # a logistic curve is 1 / (1 + exp(-x))
        self.wh_gates *= -1
        self.wc, self.bc, self.ww, self.bw = (self.p[k] for k in ("wc", "bc", "ww", "bw"))
        self.class_shares, self.head_ones = np.exp(self.bc), np.ones(HEAD_CLASS, np.float32)
        most = window * batch
        self.logits, self.numbers = np.empty((rows, len(self.bc)), np.float32), np.arange(most)
        self.zr, self.zr_of_state = np.empty((batch, gates), np.float32), np.empty((batch, gates), np.float32)
        self.new, self.new_of_input = np.empty((batch, STATE), np.float32), np.empty((batch, STATE), np.float32)
        self.states, self.taken, self.own = (np.empty((most, STATE), np.float32) for _ in range(3))
        self.within = np.empty((most, HEAD_CLASS), np.float32)

    def _outputs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """ln P(target | state) of flat arrays, in parts that stay in the processor's cache."""
        shape, n = self.shape, len(targets)
        classes = shape.class_of(targets)
        out, sums = self.bc[classes], np.empty(n, np.float32)
        for low in range(0, n, self.rows):
            part = states[low : low + self.rows]
            logits = np.matmul(part, self.wc, out=self.logits[: len(part)])
            out[low : low + len(part)] += logits[self.numbers[: len(part)], classes[low : low + len(part)]]
            # of moderate size: no shift is needed for the exponentials; the biases are factors of the sum
            np.matmul(np.exp(logits, out=logits), self.class_shares, out=sums[low : low + len(part)])
        head = np.flatnonzero(targets < shape.n_head)
        if len(head):
            order = np.argsort(classes[head].astype(np.int16), kind="stable")
            head = head[order]
            groups, words = classes[head], targets[head] % HEAD_CLASS
            own = np.take(states, head, axis=0, out=self.own[: len(head)], mode="clip")
            within, starts = self.within[: len(head)], _starts(groups)
            for k, low, high in zip(groups[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(head)]):
                part = np.matmul(own[low:high], self.ww[k], out=within[low:high])
                part += self.bw[k]
            out[head] += within[self.numbers[: len(head)], words]
            sums[head] *= np.exp(within, out=within) @ self.head_ones
        out -= np.log(sums, out=sums)
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """ln P of each sequence of token numbers, each of which ends with ``END``."""
        return self.score_joined(np.concatenate(texts), np.array([len(t) for t in texts]))

    def score_joined(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same of texts that lie one after another in one array."""
        total, firsts = np.zeros(len(lengths)), np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        for low in range(0, len(order), self.batch):
            names = order[low : low + self.batch]
            self._score_block(tokens, firsts[names], lengths[names], names, total)
        return total

    def _score_block(self, tokens: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, names: np.ndarray, total: np.ndarray) -> None:
        """Texts of falling length: those that have ended drop out behind."""
        h = np.zeros((len(names), STATE), np.float32)
        last = np.full(len(names), END)
        for start in range(0, int(lengths[0]), self.window):
            live = int((lengths > start).sum())
            steps = np.arange(start, min(start + self.window, int(lengths[0])))[:, None]
            used = steps < lengths[:live]
            targets = np.take(tokens, np.minimum(steps, lengths[:live] - 1) + firsts[:live])
            inputs = np.concatenate([last[None, :live], targets[:-1]])
            last = targets[-1]
            h = h[:live].copy()
            zr, zr_of_state, n, n_of_input = self.zr[:live], self.zr_of_state[:live], self.new[:live], self.new_of_input[:live]
            z, r = zr[:, :STATE], zr[:, STATE:]
            states = self.states[: len(steps) * live].reshape(len(steps), live, STATE)
            for ids, state in zip(inputs, states):
                np.take(self.to_gates, ids, axis=0, out=zr, mode="clip")
                zr += np.matmul(h, self.wh_gates, out=zr_of_state)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.matmul(h, self.wh_new, out=n)
                n *= r
                n += np.take(self.to_new, ids, axis=0, out=n_of_input, mode="clip")
                np.tanh(n, out=n)
                h = np.subtract(h, n, out=state)
                h *= z
                h += n
            flat, wanted, of = states.reshape(-1, STATE), targets.reshape(-1), np.broadcast_to(names[:live], targets.shape).reshape(-1)
            if not used.all():
                at = np.flatnonzero(used)
                flat, wanted, of = np.take(flat, at, axis=0, out=self.taken[: len(at)], mode="clip"), wanted[at], of[at]
            total += np.bincount(of, self._outputs(flat, wanted), len(total))


def train_on(shape: Shape, flat: np.ndarray, stream: np.ndarray, rate: float, window: int = 20, batch: int = 32) -> np.ndarray:
    """Parameters after one pass over a stream of token numbers (texts one after another), by truncated backpropagation with Adam.

    The stream is cut into parallel lanes; in each the state goes on from window to window and starts anew after ``END``.
    The last lane starts a little earlier where the lengths do not come out even, so that no token is left out.
    """
    flat = flat.copy()
    p, grad = shape.views(flat), np.zeros_like(flat)
    g = shape.views(grad)
    lanes = max(1, min(batch, len(stream) // (4 * window)))
    length = -(-(len(stream) - 1) // lanes)
    if length < 1:
        return flat
    starts = [min(k * length, len(stream) - 1 - length) for k in range(lanes)]
    lane = np.stack([stream[k : k + length + 1] for k in starts], axis=1)  # (length + 1, lanes)
    m, v, root = (np.zeros_like(flat) for _ in range(3))
    h = np.zeros((STATE, lanes), np.float32)
    step = 0
    for low in range(0, length, window):
        x_ids, targets = lane[low : min(low + window, length)], lane[low + 1 : min(low + window, length) + 1]
        grad[:] = 0
        h = _window(shape, p, g, h, x_ids, targets)
        norm = float(np.sqrt(grad @ grad))
        if norm > 1.0:
            grad /= norm
        step += 1
        # Adam: flat -= rate * m' / (sqrt(v') + 1e-6), with m ten times and v a hundred times the running means, which saves passes over them
        m *= 0.9
        m += grad
        v *= 0.99
        grad *= grad
        v += grad
        seen = (1 - 0.99**step) ** 0.5
        np.sqrt(v, out=root)
        root += 1e-5 * seen
        np.divide(m, root, out=root)
        root *= rate * seen / (1 - 0.9**step)
        flat -= root
    return flat


class _Work:
    """Arrays of one window of ``steps`` by ``lanes`` tokens, and their parts step by step, made once for all windows of that size.

    Arrays made anew in every window would be given back to the system and cleared by it each time. Blocks of (lanes, ``STATE``)
    lie one after another, those of each gate in step order, so that no step copies or reorders.
    """

    def __init__(self, steps: int, lanes: int, shape: Shape, dtype: np.dtype) -> None:
        def make(*size: int) -> np.ndarray:
            return np.empty(size, dtype)

        one = (steps, lanes, STATE)
        self.x, self.a, self.zr = make(3, *one), make(3, *one), make(2, *one)
        self.n, self.states, self.before = make(*one), make(*one), make(*one)
        self.to_z, self.to_n, self.to_r, self.spare = make(*one), make(*one), make(*one), make(*one)
        self.da, self.dn, self.carry = make(steps, lanes, 3 * STATE), make(*one), make(lanes, STATE)
        n, c, k = steps * lanes, shape.n_groups + shape.n_tail, steps * lanes // CHUNK + shape.n_groups
        self.ones, self.class_ones, self.head_ones = np.ones(n, dtype), np.ones(c, dtype), np.ones(HEAD_CLASS, dtype)
        self.numbers = np.arange(max(n, k * CHUNK))
        self.embedded, self.by_input = make(n, INPUT), make(n, INPUT)
        self.outputs, self.scaled = np.ones((n, STATE + 1), dtype), make(n, STATE + 1)  # states, and a column of ones for the biases
        self.error, self.classes, self.d_states = make(n, c), make(STATE + 1, c), make(n, STATE)
        self.heads, self.weights = make(shape.n_groups, STATE + 1, HEAD_CLASS), make(k, STATE + 1, HEAD_CLASS)
        self.own, self.within, self.back_own, self.by_chunk = make(k, CHUNK, STATE + 1), make(k, CHUNK, HEAD_CLASS), make(k, CHUNK, STATE), make(k, STATE + 1, HEAD_CLASS)
        self.forward = [
            (t, self.a[:, t], self.a[:2, t], self.a[2, t], self.x[:2, t], self.x[2, t], self.zr[:, t], self.zr[0, t], self.zr[1, t], self.n[t], self.states[t])
            for t in range(steps)
        ]
        da, s = self.da, STATE
        self.backward = [
            (t, self.to_z[t], self.to_n[t], self.to_r[t], self.zr[0, t], self.zr[1, t], self.dn[t], da[t], da[t, :, :s], da[t, :, s : 2 * s], da[t, :, 2 * s :])
            for t in reversed(range(steps))
        ]


_work = functools.lru_cache(4)(_Work)


def _blocks(weights: np.ndarray) -> np.ndarray:
    """(n, 3 gates) as three blocks; those of the two logistic gates are negated: a logistic curve is 1 / (1 + exp(-x))."""
    out = np.array(weights.reshape(-1, 3, STATE).transpose(1, 0, 2), order="C")
    np.negative(out[:2], out=out[:2])
    return out


def _window(shape: Shape, p: dict, g: dict, h: np.ndarray, x_ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """One window forward and back: sets the gradients of the mean loss in ``g``, which must be 0, returns the last state.

    States come and go as (``STATE``, lanes); in between they are rows.
    """
    steps, lanes = x_ids.shape
    n, s, w = steps * lanes, STATE, _work(steps, lanes, shape, p["wh"].dtype)
    ids = x_ids.reshape(-1)
    embedded = np.take(p["embed"], ids, axis=0, out=w.embedded, mode="clip")
    x = np.matmul(embedded, _blocks(p["wx"]), out=w.x.reshape(3, n, s))
    x += _blocks(p["b"])
    from_state = _blocks(p["wh"])
    goes_on = (x_ids != END)[:, :, None]
    ends = (~goes_on).any(axis=(1, 2)).tolist()
    w.before[0] = h = np.ascontiguousarray(h.T)
    add, multiply, exp, reciprocal, tanh, subtract, matmul = np.add, np.multiply, np.exp, np.reciprocal, np.tanh, np.subtract, np.matmul
    for t, a, a_gates, a_new, x_gates, x_new, zr, z, r, new, state in w.forward:
        if ends[t]:
            h = h * goes_on[t]
        matmul(h, from_state, out=a)
        add(a_gates, x_gates, out=zr)
        exp(zr, out=zr)
        add(zr, 1, out=zr)
        reciprocal(zr, out=zr)
        multiply(r, a_new, out=new)
        add(new, x_new, out=new)
        tanh(new, out=new)
        subtract(h, new, out=state)
        multiply(state, z, out=state)
        h = add(state, new, out=state)
    w.before[1:] = w.states[:-1]
    w.before *= goes_on
    w.outputs[:, :s] = w.states.reshape(n, s)
    d_states = _output_gradients(shape, p, g, w, targets.reshape(-1)).reshape(steps, lanes, s)
    # what every step's gradient is multiplied by, for all steps at once
    z, r, to_z, to_n, to_r, spare = w.zr[0], w.zr[1], w.to_z, w.to_n, w.to_r, w.spare
    subtract(1, z, out=to_n)
    subtract(w.before, w.n, out=to_z)
    multiply(to_z, z, out=to_z)
    multiply(to_z, to_n, out=to_z)
    multiply(w.n, w.n, out=spare)
    subtract(1, spare, out=spare)
    multiply(to_n, spare, out=to_n)
    subtract(1, r, out=to_r)
    multiply(to_r, r, out=to_r)
    multiply(to_r, w.a[2], out=to_r)
    carry, back = w.carry, np.ascontiguousarray(p["wh"].T)
    carry[:] = 0
    for t, by_z, by_n, by_r, z, r, new, da, da_z, da_r, da_new in w.backward:
        d = d_states[t]
        add(d, carry, out=d)
        multiply(d, by_z, out=da_z)
        multiply(d, by_n, out=new)
        multiply(new, by_r, out=da_r)
        multiply(new, r, out=da_new)
        multiply(d, z, out=d)
        matmul(da, back, out=carry)
        add(carry, d, out=carry)
        if ends[t]:
            carry *= goes_on[t]
    flat_dx = w.da.reshape(n, 3 * s)
    g["wh"][:] = (flat_dx.T @ w.before.reshape(n, s)).T
    flat_dx[:, 2 * s :] = w.dn.reshape(n, s)
    g["wx"][:] = (flat_dx.T @ embedded).T
    matmul(w.ones, flat_dx, out=g["b"])
    order = np.argsort(ids.astype(np.int16) if shape.n_head + shape.n_tail < 1 << 15 else ids, kind="stable")  # short numbers are sorted digit by digit
    found = ids[order]
    first = _starts(found)
    by_input = np.take(matmul(flat_dx, p["wx"].T, out=embedded), order, axis=0, out=w.by_input, mode="clip")
    g["embed"][found[first]] = np.add.reduceat(by_input, first, axis=0)
    return h.T


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Positions where another value begins."""
    begins = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=begins[1:])
    return np.flatnonzero(begins)


def _softmax_error(x: np.ndarray, ones: np.ndarray, targets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Logits, in place, to what ``scale`` times it is the gradient of the mean loss over ``n`` rows; returns ``scale``, one for each row.

    Logits are of moderate size, as states are in -1 to 1: no shift is needed. ``targets`` are those of ``rows``.
    """
    np.exp(x, out=x)
    sums = x @ ones
    x[rows, targets] -= sums[rows]
    sums *= n
    return np.reciprocal(sums, out=sums)[:, None]


def _output_gradients(shape: Shape, p: dict, g: dict, w: _Work, targets: np.ndarray) -> np.ndarray:
    """Sets the gradients of both softmaxes' parameters; returns those of the states."""
    n, s, states = len(targets), STATE, w.outputs
    w.classes[:s], w.classes[s] = p["wc"], p["bc"]
    error = np.matmul(states, w.classes, out=w.error)
    scale = _softmax_error(error, w.class_ones, shape.class_of(targets), w.numbers[:n], n)
    both = error.T @ np.multiply(states, scale, out=w.scaled)
    g["wc"][:], g["bc"][:] = both[:, :s].T, both[:, s]
    d_states = np.matmul(error, p["wc"].T, out=w.d_states)
    d_states *= scale
    head = np.flatnonzero(targets < shape.n_head)
    if not len(head):
        return d_states
    words = targets[head]
    groups = (words // HEAD_CLASS).astype(np.int16)
    order = np.argsort(groups, kind="stable")
    head, words, groups = head[order], words[order] % HEAD_CLASS, groups[order]
    # the rows of a group fill chunks, the last one with zeros: one product over all chunks of all groups
    counts = np.bincount(groups, minlength=shape.n_groups)
    chunks = -(-counts // CHUNK)
    of_group = np.repeat(w.numbers[: shape.n_groups], chunks)
    k = len(of_group)
    place = (CHUNK * (np.cumsum(chunks) - chunks) - np.cumsum(counts) + counts)[groups]
    place += w.numbers[: len(head)]
    w.heads[:, :s], w.heads[:, s] = p["ww"], p["bw"]
    weights = np.take(w.heads, of_group, axis=0, out=w.weights[:k], mode="clip")
    own, within = w.own[:k], w.within[:k]
    own_rows, rows = own.reshape(-1, s + 1), within.reshape(-1, HEAD_CLASS)
    own_rows[:] = 0
    own_rows[place] = states[head]
    np.matmul(own, weights, out=within)
    scale = _softmax_error(rows, w.head_ones, words, place, n)
    back = np.matmul(within, weights[:, :s].transpose(0, 2, 1), out=w.back_own[:k]).reshape(-1, s)
    back *= scale
    d_states[head] += back[place]
    own_rows *= scale
    by_chunk = np.matmul(own.transpose(0, 2, 1), within, out=w.by_chunk[:k]).reshape(k, -1)
    kinds = np.flatnonzero(counts)
    both = ((kinds[:, None] == of_group).astype(by_chunk.dtype) @ by_chunk).reshape(-1, s + 1, HEAD_CLASS)
    g["ww"][kinds], g["bw"][kinds] = both[:, :s], both[:, s]
    return d_states
