"""A bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_params(rng: np.random.Generator, inputs: int, hidden: int, attention: int) -> Params:
    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    out: Params = {}
    for side in "fb":
        out |= {f"W{side}": draw(inputs, 3 * hidden), f"U{side}": draw(hidden, 3 * hidden), f"c{side}": np.zeros(3 * hidden, np.float32)}
    return out | {"A": draw(2 * hidden, attention), "a": draw(attention), "w": draw(2 * hidden), "b": np.full(1, -1.0, np.float32)}


def run_side(p: Params, side: str, project: Callable[[int], np.ndarray], mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, (steps, rows, hidden). ``project(t)`` gives the inputs' share of the gates at step t."""
    steps, rows = mask.shape[1], mask.shape[0]
    u = p[f"U{side}"]
    hidden = u.shape[0]
    state = np.zeros((rows, hidden), np.float32)
    states, kept = np.empty((steps, rows, hidden), np.float32), []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        gates, past = project(t), state @ u
        zr = _sigmoid(gates[:, : 2 * hidden] + past[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(gates[:, 2 * hidden :] + r * past[:, 2 * hidden :])
        new = n + z * (state - n)
        live = mask[:, t, None]
        if keep:
            kept.append((t, state, z, r, n, past[:, 2 * hidden :]))
        state = np.where(live, new, state)
        states[t] = state
    return states, kept


def pool(p: Params, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of attention-pooled states; a row without words has zero states and so gets the bias alone."""
    scored = np.tanh(states @ p["A"])
    score = np.where(mask.T, scored @ p["a"], np.float32(-30.0))
    score = np.exp(score - score.max(axis=0))
    share = score / score.sum(axis=0)
    share = share * mask.T
    pooled = np.einsum("tn,tnh->nh", share, states)
    return pooled @ p["w"] + p["b"][0], (scored, share, pooled)


def forward(p: Params, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows ``x`` (rows, steps, inputs), and what the gradient needs."""
    sides = {}
    for side in "fb":
        gates = x @ p[f"W{side}"] + p[f"c{side}"]
        sides[side] = run_side(p, side, lambda t, g=gates: g[:, t], mask, True)
    states = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
    logits, rest = pool(p, states, mask)
    return logits, (sides, states, *rest)


def gradients(p: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Params, np.ndarray]:
    """Mean logistic loss, its gradients and its gradient by the inputs."""
    logits, (sides, states, scored, share, pooled) = forward(p, x, mask)
    prob = 1 / (1 + np.exp(-logits))
    loss = float(np.mean(weight * (np.logaddexp(0, logits) - y * logits)))
    d = (weight * (prob - y) / len(y)).astype(np.float32)
    g: Params = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * p["w"]
    d_states = share[:, :, None] * d_pooled
    d_share = np.einsum("nh,tnh->tn", d_pooled, states) * mask.T
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    g["a"] = np.einsum("tn,tnk->k", d_score, scored)
    d_pre = d_score[:, :, None] * p["a"] * (1 - scored**2)
    g["A"] = np.einsum("tnh,tnk->hk", states, d_pre)
    d_states = d_states + d_pre @ p["A"].T
    hidden = states.shape[2] // 2
    d_x = np.zeros_like(x)
    for i, side in enumerate("fb"):
        u, w = p[f"U{side}"], p[f"W{side}"]
        g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * hidden, np.float32)
        carry = np.zeros((len(x), hidden), np.float32)
        for t, before, z, r, n, past in reversed(sides[side][1]):
            carry = carry + d_states[t, :, i * hidden : (i + 1) * hidden]
            live = mask[:, t, None]
            own = np.where(live, carry, 0)
            d_n = own * (1 - z) * (1 - n**2)
            d_z = own * (before - n) * z * (1 - z)
            d_r = d_n * past * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_n], axis=1)
            d_past = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g[f"U{side}"] += before.T @ d_past
            g[f"W{side}"] += x[:, t].T @ d_gate
            g[f"c{side}"] += d_gate.sum(axis=0)
            d_x[:, t] += d_gate @ w.T
            carry = np.where(live, own * z + d_past @ u.T, carry)
    return loss, g, d_x


class Adam:
    def __init__(self, rate: float):
        self.rate, self.seen, self.first, self.second = rate, 0, {}, {}

    def step(self, p: Params, g: Params) -> None:
        self.seen += 1
        for k, v in g.items():
            m = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * v
            s = self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * v * v
            p[k] -= (self.rate * (m / (1 - 0.9**self.seen)) / (np.sqrt(s / (1 - 0.999**self.seen)) + 1e-8)).astype(np.float32)
