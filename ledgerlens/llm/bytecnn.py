"""Convolutional network over bytes, in numpy: filters of several widths, max pooling, softmax.

A filter of width w sees w neighbouring bytes, each replaced by a short learned vector. The
narrower filters are stored as wide ones with zeros at the end, so one matrix product per slice
of text serves all widths. The positions of a text are cut into windows of fixed length, and each
filter keeps its largest answer per window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

WINDOW = 256
_SLICE = 64  # windows per matrix product: a few hundred kB per filter, which stays in cache


@dataclass
class ByteCNN:
    """`bytes_` (256, d); `filters` (F, widest, d); `bias` (F,); `out` (F, C); `out_bias` (C,)."""

    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    classes: list

    @property
    def overhang(self) -> int:
        return self.filters.shape[1] - 1

    def pooled(self, stream: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Largest answer of each filter in each window of a byte stream, (windows, F).

        The stream's length is a multiple of `window`; a filter looks over the edge into the next window.
        """
        n = len(stream) // window
        f, wide, d = self.filters.shape
        weights = self.filters.reshape(f, wide * d)
        found = np.empty((n, f), np.float32)
        padded = np.concatenate([stream, np.zeros(wide - 1, np.uint8)])
        for first in range(0, n, _SLICE):
            last = min(first + _SLICE, n)
            size = (last - first) * window
            part = padded[first * window:last * window + wide - 1]
            rows = np.take(self.bytes_.T, part, axis=1)  # (d, size + overhang)
            x = np.concatenate([rows[:, j:j + size] for j in range(wide)])  # (wide * d, size)
            found[first:last] = (weights @ x).reshape(f, last - first, window).max(axis=2).T
        return found

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def streams(texts: Sequence[bytes], overhang: int, window: int = WINDOW,
            limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end, each filled up with zeros to whole windows.

    Yields (first text, past the last, stream, first window of each text, bytes of text per window);
    a stream ends when it holds `limit` bytes, so the work space does not grow with the batch.
    """
    sizes = [len(t) for t in texts]
    room = [max(1, -(-(s + overhang) // window)) for s in sizes]
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + room[end] * window <= limit):
            total += room[end] * window
            end += 1
        stream = np.zeros(total, np.uint8)
        starts = np.concatenate([[0], np.cumsum(room[at:end])[:-1]]).astype(np.int64)
        held = np.zeros(total // window, np.int64)
        for i in range(at, end):
            s = int(starts[i - at])
            stream[s * window:s * window + sizes[i]] = np.frombuffer(texts[i], np.uint8)
            filled = np.clip(sizes[i] - window * np.arange(room[i]), 0, window)
            held[s:s + room[i]] = filled
        yield at, end, stream, starts, held
        at = end


def training_windows(texts: Sequence[bytes], overhang: int, window: int) -> np.ndarray:
    """One row of `window` bytes per text; the end stays zero so that no filter sees the next row."""
    rows = np.zeros((len(texts), window), np.uint8)
    for i, t in enumerate(texts):
        t = t[:window - overhang]
        rows[i, :len(t)] = np.frombuffer(t, np.uint8)
    return rows


def train(rows: np.ndarray, labels: np.ndarray, classes: list, widths: Sequence[int] = (2, 3, 4), per_width: int = 16,
          d: int = 4, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Adam on the cross entropy of single windows. `rows` (n, window) bytes, `labels` (n,) class numbers.

    Every class is drawn equally often. The number of steps is fixed, so the time does not depend
    on how many windows were gathered. Max pooling passes the gradient of a filter to the one
    position that won.
    """
    rng = np.random.default_rng(seed)
    n_classes, wide, f = len(classes), max(widths), len(widths) * per_width
    mask = np.zeros((f, wide, 1), np.float32)
    for k, w in enumerate(widths):
        mask[k * per_width:(k + 1) * per_width, :w] = 1
    p = {
        "bytes_": rng.normal(0, 0.5, (256, d)).astype(np.float32),
        "filters": (rng.normal(0, 1, (f, wide, d)) / np.sqrt(wide * d)).astype(np.float32) * mask,
        "bias": np.zeros(f, np.float32),
        "out": (rng.normal(0, 1, (f, n_classes)) / np.sqrt(f)).astype(np.float32),
        "out_bias": np.zeros(n_classes, np.float32),
    }
    p["bytes_"][0] = 0
    if len(rows) == 0 or n_classes < 2:
        p["out"][:] = 0
        return ByteCNN(**p, classes=list(classes))
    of_class = [np.flatnonzero(labels == c) for c in range(n_classes)]
    of_class = [x for x in of_class if len(x)]
    window = rows.shape[1]
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = np.array([of_class[i][rng.integers(len(of_class[i]))] for i in rng.integers(len(of_class), size=batch)])
        x, y = rows[pick], labels[pick]
        flat = np.concatenate([x.ravel(), np.zeros(wide - 1, np.uint8)])
        embedded = p["bytes_"][flat]
        size = batch * window
        patches = np.concatenate([embedded[j:j + size] for j in range(wide)], axis=1)
        answers = (patches @ p["filters"].reshape(f, -1).T).reshape(batch, window, f)
        where = answers.argmax(axis=1)
        top = np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0, :]
        hidden = np.maximum(top + p["bias"], 0)
        prob = softmax(hidden @ p["out"] + p["out_bias"])
        dz = prob
        dz[np.arange(batch), y] -= 1
        dz /= batch
        dh = (dz @ p["out"].T) * (hidden > 0)
        position = (np.arange(batch)[:, None] * window + where).ravel()  # winning place of (row, filter)
        won = patches[position].reshape(batch, f, wide, d)
        back = dh[:, :, None, None] * p["filters"][None]
        g_bytes = np.zeros_like(p["bytes_"])
        for j in range(wide):
            np.add.at(g_bytes, flat[position + j], back[:, :, j].reshape(-1, d))
        g_bytes[0] = 0
        grad = {
            "bytes_": g_bytes, "filters": (dh[:, :, None, None] * won).sum(axis=0) * mask, "bias": dh.sum(axis=0),
            "out": hidden.T @ dz, "out_bias": dz.sum(axis=0),
        }
        slow = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.01 * (g * g - m2[k])
            p[k] -= (slow * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return ByteCNN(**p, classes=list(classes))
