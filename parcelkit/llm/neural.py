"""A log-bilinear model of unit sequences with a factored output layer, in numpy.

The context of a token is its three predecessors and the mean of up to BAG tokens before it. Each
has a matrix; their sum predicts a vector. Units lie in classes of equal size: a unit's probability is
that of its class, by the class's vector, times that of the unit in its class, by its own vector, each
with a bias. Training is noise-contrastive at both steps: a logistic regression tells the class that
came from classes drawn by their frequencies, and the unit from units drawn inside its class. Scoring
normalises over all classes and over all units of the class, by matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

ORDER, BAG, WIDTH = 3, 32, 16
#: Classes drawn for a batch, units drawn for a token, entries of a class's table of noise.
NOISE, OWN_NOISE, TABLE = 32, 3, 1024
BATCH, RATE = 4096, 0.1
#: Tokens whose contexts are made at a time, tokens scored together, rows of one product.
SPAN, SCORED, ROWS = 8192, 1 << 17, 512


@dataclass
class LogBilinear:
    """Weights for ``side`` classes of ``side`` units; unit u lies in class u // side."""

    inputs: np.ndarray  # (units + 1, width); the last row stands before a text's begin
    outputs: np.ndarray  # (units, width)
    bias: np.ndarray  # (units,)
    class_outputs: np.ndarray  # (side, width)
    class_bias: np.ndarray  # (side,)
    mixing: np.ndarray  # (ORDER + 1, width, width)

    @classmethod
    def new(cls, share: np.ndarray, seed: int = 1) -> LogBilinear:
        """An untrained model that predicts ``share``, the units' relative frequencies, all above zero."""
        rng, n, side = np.random.default_rng(seed), len(share), int(len(share) ** 0.5)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        mixing = np.stack([np.eye(WIDTH, dtype=np.float32) * w for w in [*(0.5 / (k + 1) for k in range(ORDER)), 0.5]])
        of_class = share.reshape(side, side).sum(axis=1)
        return cls(draw(n + 1, WIDTH), draw(n, WIDTH), np.log(share / np.repeat(of_class, side)).astype(np.float32), draw(side, WIDTH), np.log(of_class).astype(np.float32), mixing)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)]).astype(np.float32)

    @classmethod
    def of_flat(cls, values: np.ndarray, side: int) -> LogBilinear:
        n = side * side
        shapes = [(n + 1, WIDTH), (n, WIDTH), (n,), (side, WIDTH), (side,), (ORDER + 1, WIDTH, WIDTH)]
        ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        return cls(*(values[a:b].reshape(s).astype(np.float32) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True)))

    @property
    def side(self) -> int:
        return len(self.class_bias)

    def contexts(self, units: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predecessors (ORDER x n) and the mean vectors (n x width); start: where each token's text begins."""
        i, none = np.arange(len(units)), len(self.outputs)
        before = np.stack([np.where(i - k >= start, units[np.maximum(i - k, 0)], none) for k in range(1, ORDER + 1)])
        sums = np.zeros((len(units) + 1, WIDTH), np.float32)
        np.cumsum(self.inputs.take(units, axis=0), axis=0, out=sums[1:])
        first = np.maximum(start, i - BAG)
        bag = sums[:-1] - sums.take(first, axis=0)
        bag /= np.maximum(i - first, 1).astype(np.float32)[:, None]
        return before, bag

    def spans(self, units: np.ndarray, start: np.ndarray):
        """(from, to, predecessors, means) of SPAN tokens at a time, with the tokens before that they look back on."""
        for lo in range(0, len(units), SPAN):
            first, hi = max(0, lo - max(BAG, ORDER)), min(len(units), lo + SPAN)
            before, bag = self.contexts(units[first:hi], np.maximum(start[first:hi] - first, 0))
            yield lo, hi, before[:, lo - first :], bag[lo - first :]

    def predict(self, before: np.ndarray, bag: np.ndarray) -> np.ndarray:
        out = bag @ self.mixing[ORDER]
        for k in range(ORDER):
            out += self.inputs.take(before[k], axis=0) @ self.mixing[k]
        return out

    @staticmethod
    def _normalised(predicted: np.ndarray, outputs: np.ndarray, bias: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log probability of each row's ``own`` choice among all outputs, ROWS rows at a time."""
        out = np.empty(len(own), np.float32)
        for at in range(0, len(own), ROWS):
            scores = predicted[at : at + ROWS] @ outputs
            scores += bias
            if scores.max() > 60:  # else no exponential overflows
                scores -= scores.max(axis=1, keepdims=True)
            mine = scores[np.arange(len(scores)), own[at : at + ROWS]]
            np.exp(scores, out=scores)
            out[at : at + ROWS] = mine - np.log(scores.sum(axis=1))
        return out

    def log10(self, units: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token's unit given its context."""
        out, side = np.empty(len(units)), self.side
        of_class, outputs = np.ascontiguousarray(self.class_outputs.T), self.outputs.reshape(side, side, WIDTH).transpose(0, 2, 1).copy()
        bias = self.bias.reshape(side, side)
        for from_ in range(0, len(units), SCORED):
            # SCORED tokens share one pass over the classes; spans look back on what stands before them.
            first, to = max(0, from_ - max(BAG, ORDER)), min(len(units), from_ + SCORED)
            predicted = np.concatenate([self.predict(before, bag) for _, _, before, bag in self.spans(units[first:to], np.maximum(start[first:to] - first, 0))])[from_ - first :]
            own = units[from_:to]
            classes = (own // side).astype(np.uint8 if side <= 256 else np.uint16)
            order = np.argsort(classes, kind="stable")
            predicted, classes, inside = predicted.take(order, axis=0), classes[order].astype(np.int64), (own % side)[order]
            found = self._normalised(predicted, of_class, self.class_bias, classes)
            edges = np.searchsorted(classes, np.arange(side + 1))
            for c in np.flatnonzero(np.diff(edges)).tolist():
                rows = slice(edges[c], edges[c + 1])
                found[rows] += self._normalised(predicted[rows], outputs[c], bias[c], inside[rows])
            out[from_ + order] = found
        return out / np.log(10)


class Trainer:
    """Noise-contrastive estimation in batches, with per-weight step sizes (Adagrad)."""

    def __init__(self, model: LogBilinear, share: np.ndarray, seed: int = 2, rate: float = RATE):
        self.model, self.rate, side = model, rate, model.side
        of_class = share.reshape(side, side).sum(axis=1)
        self.noise = np.log(NOISE * of_class).astype(np.float32)
        self.cumulated = np.cumsum(of_class)
        # A class's table holds each of its units once at least, the others by frequency; what it holds is the noise.
        inside = share.reshape(side, side) / of_class[:, None]
        ends = np.rint(np.cumsum(1 + inside * (TABLE - side), axis=1)).astype(np.int64)
        ends[:, -1] = TABLE
        self.table = np.stack([side * c + np.searchsorted(e, np.arange(TABLE), side="right") for c, e in enumerate(ends)]).ravel()
        self.own_noise = np.log(OWN_NOISE * np.maximum(np.bincount(self.table, minlength=len(share)), 1) / TABLE).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.squares = {f.name: np.full(getattr(model, f.name).shape, 0.1, np.float32) for f in fields(model)}
        self.tokens = 0

    def _step(self, name: str, gradient: np.ndarray) -> None:
        square, weights = self.squares[name], getattr(self.model, name)
        square += gradient * gradient
        gradient = gradient * np.float32(-self.rate)
        gradient /= np.sqrt(square)
        weights += gradient

    @staticmethod
    def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Sums of the values' rows that share a number in ``at``, for every number below ``size``."""
        places = (at * WIDTH)[:, None] + np.arange(WIDTH)
        return np.bincount(places.ravel(), values.ravel(), size * WIDTH).astype(np.float32).reshape(size, WIDTH)

    def train(self, units: np.ndarray, start: np.ndarray) -> None:
        """One pass over the tokens; a batch's contexts are those of the weights before it."""
        for lo, hi, before, bag in self.model.spans(units, start):
            for at in range(0, hi - lo, BATCH):
                part = slice(at, at + BATCH)
                self._batch(units[lo + at : min(hi, lo + at + BATCH)], before[:, part], bag[part])

    def _batch(self, target: np.ndarray, before: np.ndarray, bag: np.ndarray) -> None:
        m, n, side = self.model, len(target), self.model.side
        scale = np.float32(64 / n)  # gradients as of 64 tokens, however large the batch
        classes = target // side
        drawn = np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1])
        predicted = m.predict(before, bag)

        def both(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return -scale / (1 + np.exp(np.clip(own, -30, 30))), scale / (1 + np.exp(-np.clip(other, -30, 30)))

        # Classes: the tokens' own against those drawn for the batch.
        vectors, noise = m.class_outputs.take(classes, axis=0), m.class_outputs[drawn]
        d_own, d_other = both(np.einsum("nd,nd->n", predicted, vectors) + (m.class_bias - self.noise).take(classes), predicted @ noise.T + (m.class_bias - self.noise)[drawn])
        d_predicted = d_own[:, None] * vectors + d_other @ noise
        d_outputs = np.zeros((side, WIDTH + 1), np.float32)
        np.add.at(d_outputs, drawn, np.c_[d_other.T @ predicted, d_other.sum(axis=0)])
        d_outputs[:, :WIDTH] += self._sums(classes, d_own[:, None] * predicted, side)
        d_outputs[:, WIDTH] += np.bincount(classes, d_own, side)

        # Units: the tokens' own against OWN_NOISE of the same class each.
        chosen = np.empty((n, 1 + OWN_NOISE), np.int64)
        chosen[:, 0] = target
        chosen[:, 1:] = self.table.take(classes[:, None] * TABLE + self.rng.integers(0, TABLE, (n, OWN_NOISE), dtype=np.int32))
        flat = chosen.ravel()
        vectors = m.outputs.take(flat, axis=0).reshape(n, 1 + OWN_NOISE, WIDTH)
        score = np.einsum("nkd,nd->nk", vectors, predicted) + (m.bias - self.own_noise).take(chosen)
        d_chosen = np.empty_like(score)
        d_chosen[:, 0], d_chosen[:, 1:] = both(score[:, 0], score[:, 1:])
        d_predicted += np.einsum("nk,nkd->nd", d_chosen, vectors)
        vectors = np.einsum("nk,nd->nkd", d_chosen, predicted)

        d_mixing = np.stack([*(m.inputs.take(b, axis=0).T @ d_predicted for b in before), bag.T @ d_predicted])
        d_inputs = np.concatenate([d_predicted @ m.mixing[k].T for k in range(ORDER)])
        self._step("outputs", self._sums(flat, vectors, side * side))
        self._step("bias", np.bincount(flat, d_chosen.ravel(), side * side).astype(np.float32))
        self._step("inputs", self._sums(before.ravel(), d_inputs, side * side + 1))
        self._step("class_outputs", d_outputs[:, :WIDTH])
        self._step("class_bias", d_outputs[:, WIDTH])
        self._step("mixing", d_mixing)
        self.tokens += n
