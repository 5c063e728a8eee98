"""A bidirectional LSTM that labels every item of a sequence, in numpy: forward, training by back-propagation through time, Adam."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Two hashed embedding tables (sets of path numbers, bags of words), plain numbers, one LSTM per direction, one logistic unit per item."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, path_buckets: int, word_buckets: int, plain: int, seed: int, path_size: int = 16, word_size: int = 8, hidden: int = 20) -> Labeller:
        rng = np.random.default_rng(seed)
        inputs = path_size + word_size + plain
        w = {"path": rng.normal(0, 0.02, (path_buckets, path_size)), "word": rng.normal(0, 0.02, (word_buckets, word_size))}
        for side in ("ahead", "back"):
            w[f"{side} in"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
            w[f"{side} own"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w[f"{side} bias"] = np.zeros(4 * hidden)
            w[f"{side} bias"][hidden:2 * hidden] = 1  # remember at first
        w["out"] = rng.normal(0, 0.1, 2 * hidden + inputs)
        w["out bias"] = np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction; x is (time, batch, inputs), items behind a sequence's end are masked and leave the state as it is."""
        w_own = self.weights[f"{side} own"]
        hidden = w_own.shape[0]
        gates = x @ self.weights[f"{side} in"] + self.weights[f"{side} bias"]
        order = range(len(x)) if side == "ahead" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], hidden), np.float32)
        states = np.empty((len(x), x.shape[1], hidden), np.float32)
        trace = {}
        for t in order:
            z = gates[t] + h @ w_own
            s = sigmoid(z[:, :3 * hidden])
            g = np.tanh(z[:, 3 * hidden:])
            i, f, o = s[:, :hidden], s[:, hidden:2 * hidden], s[:, 2 * hidden:]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            m = mask[t][:, None]
            if keep:
                trace[t] = (h, c, i, f, o, g, tc)
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            states[t] = h
        return states, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        ahead, back = self._run("ahead", x, mask, False)[0], self._run("back", x, mask, False)[0]
        return np.concatenate([ahead, back, x], 2) @ self.weights["out"] + self.weights["out bias"]

    def _gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray):
        """Loss and gradients of the mean logistic loss over unmasked items; also the gradient of the inputs."""
        sides = {side: self._run(side, x, mask, True) for side in ("ahead", "back")}
        all_in = np.concatenate([sides["ahead"][0], sides["back"][0], x], 2)
        p = sigmoid(all_in @ self.weights["out"] + self.weights["out bias"])
        n = mask.sum()
        loss = -(np.log(np.where(label, p, 1 - p) + 1e-9) * mask).sum() / n
        d_out = (p - label) * mask / n
        grads = {"out": (d_out[:, :, None] * all_in).sum((0, 1)), "out bias": d_out.sum(keepdims=True).reshape(1)}
        d_all = d_out[:, :, None] * self.weights["out"]
        hidden = self.weights["ahead own"].shape[0]
        d_x = d_all[:, :, 2 * hidden:].copy()
        for number, side in enumerate(("ahead", "back")):
            w_own, trace = self.weights[f"{side} own"], sides[side][1]
            d_states = d_all[:, :, number * hidden:(number + 1) * hidden]
            order = range(len(x) - 1, -1, -1) if side == "ahead" else range(len(x))
            d_gates = np.zeros((len(x), x.shape[1], 4 * hidden), np.float32)
            before = np.zeros((len(x), x.shape[1], hidden), np.float32)
            d_h = d_c = np.zeros((x.shape[1], hidden), np.float32)
            for t in order:
                h, c, i, f, o, g, tc = trace[t]
                m = mask[t][:, None]
                d_here = d_h + d_states[t]
                d_new = d_c + d_here * o * (1 - tc * tc)
                d_z = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_here * tc * o * (1 - o), d_new * i * (1 - g * g)], 1)
                d_z = np.where(m, d_z, 0)
                d_gates[t], before[t] = d_z, h
                d_h = np.where(m, d_z @ w_own.T, d_here)
                d_c = np.where(m, d_new * f, d_c)
            grads[f"{side} own"] = (np.swapaxes(before, 1, 2) @ d_gates).sum(0)
            grads[f"{side} in"] = (np.swapaxes(x, 1, 2) @ d_gates).sum(0)
            grads[f"{side} bias"] = d_gates.sum((0, 1))
            d_x += d_gates @ self.weights[f"{side} in"].T
        return loss, grads, d_x


def pooled(table: np.ndarray, bags: list, mean: bool) -> np.ndarray:
    """The sum (or mean) of the table's rows for each bag of row numbers; an empty bag is zero."""
    sizes = np.fromiter(map(len, bags), int, len(bags))
    out = np.zeros((len(bags), table.shape[1]), np.float32)
    full = sizes > 0
    if full.any():
        flat = np.concatenate([np.asarray(b, int) for b in bags if len(b)])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(table[flat], starts, axis=0)
        if mean:
            out[full] /= sizes[full, None]
    return out


def padded(items: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of consecutive sequences as (time, batch, ...) and the mask of real items."""
    x = np.zeros((max(lengths), len(lengths), *items.shape[1:]), items.dtype)
    mask = np.zeros(x.shape[:2], bool)
    at = 0
    for b, n in enumerate(lengths):
        x[:n, b], mask[:n, b] = items[at:at + n], True
        at += n
    return x, mask


def train(model: Labeller, sequences: list, rounds: int, batch: int, seed: int, rate: float = 0.01, hide: float = 0.03) -> float:
    """Fit on sequences of (path numbers, word numbers, plain numbers, label) items; the loss of the last round."""
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, last = 0, 0.0
    steps = rounds * -(-len(sequences) // batch)
    # sequences of like length share a batch, so that little is padded
    by_length = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    groups = [by_length[k:k + batch] for k in range(0, len(by_length), batch)]
    for _ in range(rounds):
        total = 0.0
        for g in rng.permutation(len(groups)):
            some = [sequences[k] for k in groups[g]]
            items = [item for s in some for item in s]
            lengths = [len(s) for s in some]
            # some path numbers and a third of the words are hidden in turn, so that no single mark decides
            paths = [[p for p in item[0] if rng.random() > hide] for item in items]
            words = [item[1] if rng.random() > 0.3 else [] for item in items]
            flat = np.concatenate([pooled(model.weights["path"], paths, False), pooled(model.weights["word"], words, True),
                                   np.array([item[2] for item in items], np.float32)], 1)
            x, mask = padded(flat, lengths)
            label = padded(np.array([item[3] for item in items]), lengths)[0].astype(bool)
            loss, grads, d_x = model._gradients(x, mask, label)
            total += loss / len(groups)
            d_flat = np.swapaxes(d_x, 0, 1)[np.swapaxes(mask, 0, 1)]
            p_size, w_size = model.weights["path"].shape[1], model.weights["word"].shape[1]
            grads["path"], grads["word"] = np.zeros_like(model.weights["path"]), np.zeros_like(model.weights["word"])
            for name, bags, part, mean in (("path", paths, d_flat[:, :p_size], False), ("word", words, d_flat[:, p_size:p_size + w_size], True)):
                sizes = np.fromiter(map(len, bags), int, len(bags))
                each = np.repeat(part / np.maximum(sizes, 1)[:, None] if mean else part, sizes, axis=0)
                np.add.at(grads[name], np.concatenate([np.asarray(b, int) for b in bags]), each)
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, v in grads.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                change = now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                model.weights[k] = (model.weights[k] - change).astype(np.float32)
        last = total
    return last
