"""Small networks in numpy: forward passes that return their own backward step, losses, initial weights, optimiser steps and seeded dropout.

Everything here works on one minibatch; ``plans.trainer`` runs it over partitions. A network's parameters are one flat vector with named views, so
they can be summed, averaged and stored without knowing the network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Parameters = dict[str, np.ndarray]
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def uniforms(seeds: np.ndarray, width: int, salt: int) -> np.ndarray:
    """(rows, width) of numbers in [0, 1) that depend on a row's seed, the salt and the place only, not on the batch."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.uint64)[:, None] + (np.uint64(salt) * np.uint64(1 << 32) + np.arange(1, width + 1, dtype=np.uint64)) * _STEP
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


@dataclass
class Batch:
    """``x``: (rows, features), or (rows, positions, features) with zeros after ``sizes`` positions; ``seeds`` decide the dropout, none is none."""

    x: np.ndarray
    sizes: np.ndarray | None = None
    seeds: np.ndarray | None = None

    @property
    def mask(self) -> np.ndarray:
        return np.arange(self.x.shape[1]) < self.sizes[:, None]


Result = tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]  # what a step gives, and its input's gradient from its output's


def _dense(p: Parameters, g: Parameters, name: str, x: np.ndarray) -> Result:
    w, b = p[f"{name}.w"], p[f"{name}.b"]

    def back(d: np.ndarray) -> np.ndarray:
        flat = d.reshape(-1, d.shape[-1])
        g[f"{name}.w"] += x.reshape(-1, x.shape[-1]).T @ flat
        g[f"{name}.b"] += flat.sum(0)
        return d @ w.T

    return x @ w + b, back


def _relu(x: np.ndarray) -> Result:
    return np.maximum(x, 0), lambda d: d * (x > 0)


def _dropout(x: np.ndarray, rate: float, seeds: np.ndarray | None, salt: int) -> Result:
    if seeds is None or not rate:
        return x, lambda d: d
    keep = (uniforms(seeds, int(np.prod(x.shape[1:])), salt) >= rate).reshape(x.shape) / (1 - rate)
    return x * keep, lambda d: d * keep


def _conv(p: Parameters, g: Parameters, name: str, x: np.ndarray, kernel: int) -> Result:
    """Over positions, as many out as in; weights are (kernel * features, out)."""
    n, length, width = x.shape
    half = kernel // 2
    padded = np.pad(x, ((0, 0), (half, half), (0, 0)))
    y, back = _dense(p, g, name, np.concatenate([padded[:, k:k + length] for k in range(kernel)], axis=2))

    def through(d: np.ndarray) -> np.ndarray:
        d, out = back(d), np.zeros_like(padded)
        for k in range(kernel):
            out[:, k:k + length] += d[:, :, k * width:(k + 1) * width]
        return out[:, half:half + length]

    return y, through


def _layer_norm(p: Parameters, g: Parameters, name: str, x: np.ndarray) -> Result:
    mean, scale = x.mean(-1, keepdims=True), 1 / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    z = (x - mean) * scale

    def back(d: np.ndarray) -> np.ndarray:
        g[f"{name}.w"] += (d * z).sum(0)
        g[f"{name}.b"] += d.sum(0)
        d = d * p[f"{name}.w"]
        return scale * (d - d.mean(-1, keepdims=True) - z * (d * z).mean(-1, keepdims=True))

    return z * p[f"{name}.w"] + p[f"{name}.b"], back


@dataclass(frozen=True)
class Network:
    """Parameter shapes by name and the pass: ``forward(p, g, batch)`` gives the outputs and a function that adds to ``g`` what their gradient makes of the parameters'."""

    features: int
    shapes: dict[str, tuple[int, ...]]
    forward: Callable[[Parameters, Parameters, Batch], tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]]
    dropout: float = 0.0
    positions: bool = False  # whether a row is a sequence of feature vectors
    per_position: bool = False  # whether there is an output for each position

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def views(self, flat: np.ndarray) -> Parameters:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at:at + n].reshape(shape)
            at += n
        return out

    def initial(self, seed: int = 42, kind: str = "default") -> np.ndarray:
        """``default`` draws weights and biases within one over the root of the inputs; the others set biases to 0."""
        r, flat = np.random.default_rng(seed), np.zeros(self.size)
        for name, v in self.views(flat).items():
            if name.startswith("norm"):
                v[...] = name.endswith(".w")
                continue
            inputs, outputs = self.shapes[name[:-2] + ".w"]
            bound = {"default": inputs**-0.5, "xavier": (6 / (inputs + outputs))**0.5, "kaiming": (6 / inputs)**0.5}.get(kind)
            if kind == "normal" and name.endswith(".w"):
                v[...] = r.normal(0, 0.01, v.shape)
            elif bound and (name.endswith(".w") or kind == "default"):
                v[...] = r.uniform(-bound, bound, v.shape)
        return flat

    def outputs(self, flat: np.ndarray, batch: Batch) -> np.ndarray:
        p = self.views(flat)
        return self.forward(p, {}, batch)[0]

    def gradient(self, flat: np.ndarray, batch: Batch, loss: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
        total = np.zeros(self.size)
        out, back = self.forward(self.views(flat), self.views(total), batch)
        value, d = loss(out)
        back(d)
        return value, total


def feed_forward(features: int, outputs: int, hidden: tuple[int, ...] = (32,), dropout: float = 0.25) -> Network:
    """Linear steps with ReLU and dropout between them; without ``hidden`` a linear model."""
    widths = [features, *hidden, outputs]
    shapes = {}
    for i, (a, b) in enumerate(zip(widths, widths[1:])):
        shapes |= {f"dense{i}.w": (a, b), f"dense{i}.b": (b,)}

    def forward(p: Parameters, g: Parameters, batch: Batch):
        x, steps = batch.x, []
        for i in range(len(hidden) + 1):
            x, back = _dense(p, g, f"dense{i}", x)
            steps.append(back)
            if i < len(hidden):
                for f in (_relu, lambda v, i=i: _dropout(v, dropout, batch.seeds, i)):
                    x, back = f(x)
                    steps.append(back)
        return x, lambda d: _chain(steps, d)

    return Network(features, shapes, forward, dropout if hidden else 0.0)


def _chain(steps: list, d: np.ndarray) -> np.ndarray:
    for back in reversed(steps):
        d = back(d)
    return d


def convolutional(features: int, outputs: int, width: int = 32, kernel: int = 7, dropout: float = 0.0) -> Network:
    """Two convolutions over the positions of a sequence, an output for each position."""
    shapes = {"conv1.w": (kernel * features, width), "conv1.b": (width,), "conv2.w": (kernel * width, outputs), "conv2.b": (outputs,)}

    def forward(p: Parameters, g: Parameters, batch: Batch):
        mask, steps = batch.mask[:, :, None], []
        x = batch.x
        for f in (lambda v: _conv(p, g, "conv1", v, kernel), _relu, lambda v: (v * mask, lambda d: d * mask), lambda v: _dropout(v, dropout, batch.seeds, 0),
                  lambda v: _conv(p, g, "conv2", v, kernel), lambda v: (v * mask, lambda d: d * mask)):
            x, back = f(x)
            steps.append(back)
        return x, lambda d: _chain(steps, d)

    return Network(features, shapes, forward, dropout, positions=True, per_position=True)


def light_attention(features: int, outputs: int, width: int = 32, kernel: int = 9, dropout: float = 0.25) -> Network:
    """Convolved features, summed by the softmax over positions of an attention convolution and joined with their maximum; an output for each sequence.

    Sums and maximum are over the positions of the sequence alone, so a sequence's output doesn't depend on how far its batch is padded.
    """
    shapes = {"feature.w": (kernel * features, features), "feature.b": (features,), "attention.w": (kernel * features, features), "attention.b": (features,),
              "dense.w": (2 * features, width), "dense.b": (width,), "norm.w": (width,), "norm.b": (width,), "out.w": (width, outputs), "out.b": (outputs,)}

    def forward(p: Parameters, g: Parameters, batch: Batch):
        mask = batch.mask[:, :, None]
        o, back_o = _conv(p, g, "feature", batch.x, kernel)
        o, back_drop = _dropout(o, dropout, batch.seeds, 0)
        a, back_a = _conv(p, g, "attention", batch.x, kernel)
        a = np.where(mask, a, -np.inf)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        top = np.where(mask, o, -np.inf).argmax(1)[:, None, :]
        pooled = (o * a).sum(1)
        x, steps = np.concatenate([pooled, np.take_along_axis(o, top, 1)[:, 0]], 1), []
        for f in (lambda v: _dense(p, g, "dense", v), lambda v: _dropout(v, dropout, batch.seeds, 1), _relu, lambda v: _layer_norm(p, g, "norm", v), lambda v: _dense(p, g, "out", v)):
            x, back = f(x)
            steps.append(back)

        def through(d: np.ndarray) -> np.ndarray:
            d = _chain(steps, d)
            d_sum, d_top = d[:, None, :features], d[:, None, features:]
            d_o = d_sum * a
            np.put_along_axis(d_o, top, np.take_along_axis(d_o, top, 1) + d_top, 1)
            d_a = d_sum * a * (o - pooled[:, None])
            return back_o(back_drop(d_o)) + back_a(d_a)

        return x, through

    return Network(features, shapes, forward, dropout, positions=True)


def cross_entropy(labels: np.ndarray, weights: np.ndarray | None = None) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean over labels that are no NaN, by class weights where given. Labels have the outputs' shape without the last axis."""
    def loss(out: np.ndarray) -> tuple[float, np.ndarray]:
        known = ~np.isnan(labels)
        y, z = labels[known].astype(int), out[known]
        w = np.ones(len(y)) if weights is None else weights[y]
        z = z - z.max(-1, keepdims=True)
        e = np.exp(z)
        s = e.sum(-1)
        total = max(w.sum(), 1e-300)
        d = e / s[:, None]
        d[np.arange(len(y)), y] -= 1
        grad = np.zeros_like(out)
        grad[known] = d * (w / total)[:, None]
        return float((w * (np.log(s) - z[np.arange(len(y)), y])).sum() / total), grad

    return loss


def squared_error(labels: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    def loss(out: np.ndarray) -> tuple[float, np.ndarray]:
        known = ~np.isnan(labels)
        off = out[..., 0][known] - labels[known]
        grad = np.zeros_like(out)
        grad[known, 0] = 2 * off / max(len(off), 1)
        return float((off**2).sum() / max(len(off), 1)), grad

    return loss


def softmax(out: np.ndarray) -> np.ndarray:
    e = np.exp(out - out.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Rows of an optimiser's state beside the parameters.
STATES = {"adam": 3, "sgd": 1}


def step(optimizer: str, state: np.ndarray, gradient: np.ndarray, t: float, rate: float) -> None:
    """One step in place; ``state`` has the parameters in its first row. ``adam`` is AdamW with the largest second moment and a decay of 0.01, ``sgd`` has momentum 0.9.

    ``t`` counts the steps from 1.
    """
    p = state[0]
    if optimizer == "sgd":
        state[1] = 0.9 * state[1] + gradient
        p -= rate * state[1]
        return
    m, v, top = state[1:]
    p *= 1 - rate * 0.01
    m += 0.1 * (gradient - m)
    v += 0.001 * (gradient**2 - v)
    np.maximum(top, v, out=top)
    p -= rate / (1 - 0.9**t) * m / (np.sqrt(top / (1 - 0.999**t)) + 1e-8)
