"""A bidirectional LSTM in numpy that labels the blocks of a page."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_model(inputs: int, hidden: int = 20, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {}
    for side in ("f", "b"):
        model[f"x{side}"] = rng.normal(0, 0.05, (inputs, 4 * hidden))
        model[f"h{side}"] = rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 4 * hidden))
        model[f"c{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    return model | {"out": rng.normal(0, 0.2, 2 * hidden), "bias": np.zeros(1)}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(step, page, input) and the steps' mask (step, page)."""
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32), np.zeros((longest, len(pages), 1), np.float32)
    for i, page in enumerate(pages):
        x[: len(page), i], mask[: len(page), i] = page, 1
    return x, mask


def _run(model: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states of one direction; padded steps carry the state on unchanged."""
    hidden = len(model["out"]) // 2
    steps, n, _ = x.shape
    inputs = x.reshape(steps * n, -1) @ model[f"x{side}"].astype(np.float32)
    inputs = inputs.reshape(steps, n, -1) + model[f"c{side}"].astype(np.float32)
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    out = np.zeros((steps, n, hidden), np.float32)
    weights = model[f"h{side}"].astype(np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = inputs[t] + h @ weights
        i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
        g = np.tanh(z[:, 3 * hidden :])
        new_c = f * c + i * g
        squashed = np.tanh(new_c)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, squashed))
        m = mask[t]
        h, c = m * (o * squashed) + (1 - m) * h, m * new_c + (1 - m) * c
        out[t] = h
    return out


def scores(model: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The probability (step, page) that a block is main text."""
    states = np.concatenate([_run(model, side, x, mask, None) for side in ("f", "b")], axis=2)
    return _sigmoid(states @ model["out"].astype(np.float32) + model["bias"][0])


def _gradients(model: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    kept: dict[str, list] = {"f": [], "b": []}
    states = {side: _run(model, side, x, mask, kept[side]) for side in ("f", "b")}
    both = np.concatenate([states["f"], states["b"]], axis=2)
    p = _sigmoid(both @ model["out"] + model["bias"][0])
    real = mask[:, :, 0]
    error = (p - y) * real / real.sum()
    loss = -(real * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / real.sum()
    grads = {"out": (both * error[:, :, None]).sum(axis=(0, 1)), "bias": np.array([error.sum()])}
    hidden = len(model["out"]) // 2
    for k, side in enumerate(("f", "b")):
        up = error[:, :, None] * model["out"][k * hidden : (k + 1) * hidden]
        dz_all = np.zeros((*x.shape[:2], 4 * hidden), np.float32)
        dw = np.zeros_like(model[f"h{side}"])
        dh, dc = np.zeros((x.shape[1], hidden)), np.zeros((x.shape[1], hidden))
        for t, h, c, i, f, o, g, squashed in reversed(kept[side]):
            m = mask[t]
            dh = dh + up[t]
            own_h, own_c = dh * m, dc * m
            dc_new = own_c + own_h * o * (1 - squashed**2)
            dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), own_h * squashed * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            dw += h.T @ dz
            dh, dc = dz @ model[f"h{side}"].T + dh * (1 - m), dc_new * f + dc * (1 - m)
        grads[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * hidden)
        grads[f"h{side}"], grads[f"c{side}"] = dw, dz_all.sum(axis=(0, 1))
    return float(loss), grads


def train(pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 8, rate: float = 0.02, batch: int = 32, seed: int = 0) -> dict:
    """Adam on batches of pages of similar length; the same pages give the same model."""
    model = new_model(pages[0].shape[1], seed=seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    order = np.argsort([len(p) for p in pages], kind="stable")
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    turn = 0
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            x, mask = padded([pages[i] for i in groups[g]])
            y = padded([labels[i][:, None] for i in groups[g]])[0][:, :, 0]
            _, grads = _gradients(model, x, mask, y)
            turn += 1
            for k, v in grads.items():
                v = np.clip(v, -1, 1) + 1e-5 * model[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model[k] = model[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return model
