"""Models of one shape side by side, advanced together over the rows of their series. Runs in Python workers."""

from __future__ import annotations

import numpy as np

#: Positions whose scores or traces are collected before they become one piece.
PIECE_ROWS = 4096


class Fleet:
    """Equal-shaped models: axis 0 is the model, those with most rows first."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, neurons: int, perceptron: bool, *, eta, momentum, done, start, length, number):
        self.start, self.length, self.done, self.number = (np.asarray(a).astype(np.int64) for a in (start, length, done, number))
        self.eta, self.momentum = (np.asarray(a).astype(float) for a in (eta, momentum))
        self.neurons = neurons
        self.perceptron = perceptron
        cut = weights.shape[1] - (neurons + 1) if neurons else 0
        split = lambda a: (a[:, :cut].reshape(len(a), neurons, -1).copy() if neurons else None, a[:, cut:].copy())
        self.hidden, self.output = split(weights)
        self.hidden_step, self.output_step = split(steps)

    def _flat(self, hidden, output) -> np.ndarray:
        return output if hidden is None else np.concatenate([hidden.reshape(len(hidden), -1), output], axis=1)

    def weights(self) -> np.ndarray:
        return self._flat(self.hidden, self.output)

    def steps(self) -> np.ndarray:
        return self._flat(self.hidden_step, self.output_step)

    def advance(self, x: np.ndarray, y: np.ndarray, trace_every: int | None, keep_scores: bool = False, marks: np.ndarray | None = None):
        """One pass over the rows of every model: errors, hits, and pieces (models, numbers, weights or scores, differences).

        ``marks`` (model, any number) are update numbers before which a model's weights are kept.
        """
        count = len(self.start)
        sse, hits = np.zeros(count), np.zeros(count, dtype=np.int64)
        traced, scored, marked = _Pieces(count), _Pieces(count), _Pieces(count)
        due = self._due(marks)
        longest = int(self.length[0]) if count else 0
        active = count - np.searchsorted(self.length[::-1], np.arange(longest), side="right")
        update = self._two_layer if self.neurons else self._one_layer
        with np.errstate(over="ignore"):
            for position, m in enumerate(active):
                if trace_every and not self.neurons:
                    step = self.done[:m] + position
                    lanes = np.flatnonzero(step % trace_every == 0)
                    traced.add(lanes, step[lanes], self.output[lanes].copy(), np.zeros((len(lanes), 0)))
                if position in due:
                    lanes = due[position]
                    marked.add(lanes, self.done[lanes] + position, self.weights()[lanes], np.zeros((len(lanes), 0)))
                at = self.start[:m] + position
                target = y[at]
                p = update(m, x[at], target)
                sse[:m] += 0.5 * (target - p) ** 2
                hits[:m] += (p >= 0.5) == (target >= 0.5)
                if keep_scores:
                    scored.add(np.arange(m), self.number[:m] + position, p[:, None], (target - p)[:, None])
        self.done = self.done + self.length
        return sse, hits, traced.taken(), scored.taken(), marked.taken()

    def _due(self, marks: np.ndarray | None) -> dict[int, np.ndarray]:
        """The models to mark, by position."""
        if marks is None or not marks.size:
            return {}
        position = marks - self.done[:, None]
        position[(position < 0) | (position >= self.length[:, None])] = -1
        return {int(at): np.unique(np.nonzero(position == at)[0]) for at in np.unique(position) if at >= 0}

    def _one_layer(self, m: int, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        w = self.output[:m]
        p = 1.0 / (1.0 + np.exp(-np.einsum("mk,mk->m", x, w)))
        error = target - ((p >= 0.5) if self.perceptron else p)
        w += (self.eta[:m] * error * p * (1.0 - p))[:, None] * x
        return p

    def _two_layer(self, m: int, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        hidden, output = self.hidden[:m], self.output[:m]
        eta, momentum = self.eta[:m, None], self.momentum[:m, None]
        h = 1.0 / (1.0 + np.exp(-np.matmul(hidden, x[:, :, None])[:, :, 0]))
        p = 1.0 / (1.0 + np.exp(-(output[:, 0] + np.einsum("mn,mn->m", h, output[:, 1:]))))
        e = ((p - target) * p * (1.0 - p))[:, None]
        slope = e * output[:, 1:] * h * (1.0 - h)
        move, hidden_move = self.output_step[:m], self.hidden_step[:m]
        move *= momentum
        move[:, :1] += eta * e
        move[:, 1:] += eta * e * h
        hidden_move *= momentum[:, :, None]
        hidden_move += (eta * slope)[:, :, None] * x[:, None, :]
        output -= move
        hidden -= hidden_move
        return p


class _Pieces:
    """Values collected position by position, handed out as arrays per model of at most PIECE_ROWS positions."""

    def __init__(self, models: int):
        self.models, self.open, self.done = models, [], []

    def add(self, *values: np.ndarray) -> None:
        if len(values[0]):
            self.open.append(values)
            if len(self.open) == PIECE_ROWS:
                self._close()

    def _close(self) -> None:
        if self.open:
            lanes, numbers, weights, steps = (np.concatenate(part) for part in zip(*self.open))
            order = np.argsort(lanes, kind="stable")
            cuts = np.flatnonzero(np.diff(lanes[order])) + 1
            parts = [[a.ravel() for a in np.split(values[order], cuts)] for values in (numbers, weights, steps)]
            self.done.append((lanes[order][np.concatenate([[0], cuts])], *parts))
        self.open = []

    def taken(self) -> list[tuple]:
        self._close()
        return self.done
