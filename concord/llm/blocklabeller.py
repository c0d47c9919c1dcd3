"""A bidirectional LSTM in numpy that tells main text from the rest, block by block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 24
#: From this probability on a block counts as main text: a lost paragraph is worse than a kept line.
LEAST = 0.2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(width: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for way in "fb":
        p[f"w{way}"] = rng.normal(0, 0.1, (width, 4 * HIDDEN)).astype(np.float32)
        p[f"u{way}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"c{way}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
    return p | {"v": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "d": np.zeros(1, np.float32)}


def _run(p: dict, way: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, time first. A masked step leaves the state at zero."""
    t, b, _ = x.shape
    z_in = x.reshape(t * b, -1) @ p[f"w{way}"] + p[f"c{way}"]
    z_in = z_in.reshape(t, b, -1)
    h = c = np.zeros((b, HIDDEN), np.float32)
    out, steps, k = np.zeros((t, b, HIDDEN), np.float32), [], HIDDEN
    for at in range(t) if way == "f" else range(t - 1, -1, -1):
        z = z_in[at] + h @ p[f"u{way}"]
        gates, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
        i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
        m = mask[at][:, None]
        new = (f * c + i * g) * m
        shown = np.tanh(new)
        if keep:
            steps.append((at, h, c, i, f, o, g, shown, m))
        h, c = o * shown * m, new
        out[at] = h
    return out, steps


def scores(p: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Probability that each block is main text; x is time by page by feature."""
    h = np.concatenate([_run(p, "f", x, mask, False)[0], _run(p, "b", x, mask, False)[0]], 2)
    return _sigmoid(h @ p["v"] + p["d"])


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over unmasked blocks, by backpropagation through time."""
    runs = {way: _run(p, way, x, mask, True) for way in "fb"}
    h = np.concatenate([runs["f"][0], runs["b"][0]], 2)
    err = (_sigmoid(h @ p["v"] + p["d"]) - y) * mask / max(1.0, mask.sum())
    out = {"v": np.tensordot(err, h, 2), "d": np.array([err.sum()], np.float32)}
    flat = x.reshape(-1, x.shape[2])
    for n, way in enumerate("fb"):
        from_top = err[:, :, None] * p["v"][n * HIDDEN : (n + 1) * HIDDEN]
        u, dz_all = p[f"u{way}"], np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        du = np.zeros_like(u)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for at, h0, c0, i, f, o, g, shown, m in reversed(runs[way][1]):
            dh = (dh + from_top[at]) * m
            dc = (dc + dh * o * (1 - shown * shown)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * shown * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[at] = dz
            du += h0.T @ dz
            dh, dc = dz @ u.T, dc * f
        dz_flat = dz_all.reshape(-1, 4 * HIDDEN)
        out |= {f"w{way}": flat.T @ dz_flat, f"u{way}": du, f"c{way}": dz_flat.sum(0)}
    return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(features, mask), time first, of pages of unequal length."""
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), pages[0].shape[1]), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


@dataclass
class Labeller:
    weights: dict[str, np.ndarray]
    #: Blocks that are run at once; a longer page is run alone.
    room: int = 20_000

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        while order:
            group = [order.pop()]
            while order and len(group) < self.room // len(pages[group[0]]):
                group.append(order.pop())
            found = scores(self.weights, *padded([pages[k] for k in group])) >= LEAST
            for j, k in enumerate(group):
                out[k] = found[: len(pages[k]), j]
        return out


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, batch: int = 16, rate: float = 0.01, seed: int = 3) -> Labeller:
    """A labeller fitted by Adam on pages whose blocks are labelled 1 (main text) or 0."""
    rng, p = np.random.default_rng(seed), init(pages[0].shape[1], seed)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        pools = [sorted(order[at : at + 20 * batch], key=lambda k: len(pages[k])) for at in range(0, len(order), 20 * batch)]
        batches = [pool[at : at + batch] for pool in pools for at in range(0, len(pool), batch)]  # pages of like length, for little padding
        for rows in (batches[i] for i in rng.permutation(len(batches))):
            x, mask = padded([pages[k] for k in rows])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(rows):
                y[: len(labels[k]), j] = labels[k]
            step += 1
            now = rate * (1 if epoch < epochs * 2 // 3 else 0.3)
            for k, g in gradients(p, x, mask, y).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= (now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Labeller(p)
