"""Arrays of small fitted images, many of one geometry at once: what ``raster.fit_small`` runs within a task."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa

from .. import catalogs

GEOMETRY = ("fit", "src_w", "src_h", "x", "y", "w", "h", "target_w", "target_h", "x_from", "x_to", "y_from", "y_to")
#: Places drawn at once, at most.
PLACES = 1 << 20


@functools.cache
def _table(power: float) -> np.ndarray:
    return np.array([int(255 * math.pow(v / 255, power)) for v in range(256)], np.int64)


@functools.lru_cache(4096)
def _lanczos(src: int, dst: int, first: int, end: int, taps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each source place for the places first..end-1, and their sums; as ``raster.lanczos_spans``."""
    out = np.zeros((end - first, src))
    scale = src / dst
    wide = max(scale, 1.0)
    for i in range(first, end):
        c = (i + 0.5) * scale
        for j in range(max(0, int(c - taps * wide)), min(src, math.ceil(c + taps * wide))):
            u = (j + 0.5 - c) / wide
            out[i - first, j] = 1.0 if u == 0 else 0.0 if abs(u) >= taps else taps * math.sin(math.pi * u) * math.sin(math.pi * u / taps) / (math.pi * u * math.pi * u)
    return out, np.array([sum(row) for row in out.tolist()])


@functools.lru_cache(4096)
def _gauss(first: int, n: int, size: int, weights: tuple[float, ...]) -> np.ndarray:
    """Weights of the places first..first+n-1 for each place of a blurred line of that size, its ends extended."""
    out, reach = np.zeros((size, n)), len(weights) // 2
    for i in range(size):
        for k, w in enumerate(weights):
            out[i, min(max(i + k - reach - first, 0), n - 1)] += w
    return out


def _along(lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums over the second axis, added place by place, so that they don't depend on what is drawn beside."""
    out = np.zeros((len(lines), len(weights), lines.shape[2]))
    for j in range(lines.shape[1]):
        out += weights[:, j, None] * lines[:, None, j, :]
    return out


def _both(images: np.ndarray, across: np.ndarray, down: np.ndarray, totals=(1.0, 1.0)) -> np.ndarray:
    """Images (m, h, w, channels) with sums along x, then along y."""
    m, h, w, c = images.shape
    x = _along(images.transpose(0, 2, 1, 3).reshape(m, w, h * c), across) / np.reshape(totals[0], (-1, 1))
    x = x.reshape(m, -1, h, c).transpose(0, 2, 1, 3).reshape(m, h, -1)
    return (_along(x, down) / np.reshape(totals[1], (-1, 1))).reshape(m, len(down), -1, c)


def _whole(v: np.ndarray) -> np.ndarray:
    """Rounded at six digits, then to a whole number, and held in 0..255."""
    return np.clip(v + 0.5000005, 0, 255).astype(np.int64)


def draw(packed: np.ndarray | None, m: int, geometry: tuple[int, ...], weights: tuple[float, ...]) -> np.ndarray:
    """m canvases (rows of packed r, g, b) of one geometry from packed pixels (m, src_h * src_w) of a, r, g, b; without pixels, the box is white."""
    fit, src_w, src_h, x, y, w, h, target_w, target_h, x_from, x_to, y_from, y_to = geometry
    if packed is None:
        part = np.full((m, y_to - y_from, x_to - x_from, 3), 255)
    else:
        argb = (packed.reshape(m, src_h, src_w, 1).astype(np.int64) >> np.array([24, 16, 8, 0])) & 255
        alpha = argb[..., :1]
        linear = np.concatenate([_table(catalogs.GAMMA)[argb[..., 1:]] * alpha / 255.0, alpha], axis=3)
        (across, tx), (down, ty) = _lanczos(src_w, w, x_from, x_to), _lanczos(src_h, h, y_from, y_to)
        scaled = _both(linear, across, down, (tx, ty))
        alpha = scaled[..., 3:]
        part = np.where(alpha > 0, _table(1 / catalogs.GAMMA)[_whole(scaled[..., :3] * 255.0 / np.where(alpha > 0, alpha, 1))], 0)
    if fit:
        out = _whole(_both(part, _gauss(x + x_from, x_to - x_from, target_w, weights), _gauss(y + y_from, y_to - y_from, target_h, weights)))
    else:
        out = np.zeros((m, target_h, target_w, 3), np.int64)
    x1, x2, y1, y2 = max(0, x), min(target_w, x + w), max(0, y), min(target_h, y + h)
    if x1 < x2 and y1 < y2:
        out[:, y1:y2, x1:x2] = part[:, y1 - y - y_from : y2 - y - y_from, x1 - x - x_from : x2 - x - x_from]
    return ((out[..., 0] << 16) | (out[..., 1] << 8) | out[..., 2]).reshape(m, -1).astype(np.int32)


def drawn(batches, weights: tuple[float, ...]):
    """Batches of (design_id, seq, GEOMETRY, packed) as batches of (design_id, seq, target_w, places)."""
    for whole in batches:
        if not whole.num_rows:
            continue
        sides = np.stack([whole.column(c).to_numpy() for c in ("src_w", "src_h", "target_w", "target_h")]).astype(np.int64)
        step = max(1, PLACES // int(max((sides[0] * sides[1]).max(), (sides[2] * sides[3]).max())))
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            packed = batch.column("packed")
            none = packed.is_null().to_numpy(zero_copy_only=False)
            offsets, values = packed.offsets.to_numpy(), packed.values.to_numpy()
            kinds, of = np.unique(np.stack([batch.column(c).to_numpy() for c in GEOMETRY] + [none.astype(np.int32)], axis=1), axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            parts = np.split(order, np.cumsum(np.bincount(of.ravel()))[:-1])
            out = []
            for kind, rows in zip(kinds.tolist(), parts):
                n = kind[1] * kind[2]
                own = None if kind[-1] else values[offsets[rows][:, None] + np.arange(n)]
                out.append(draw(own, len(rows), tuple(kind[:-1]), weights))
            ends = np.concatenate([[0], np.cumsum(np.repeat([o.shape[1] for o in out], [len(o) for o in out]))]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o.ravel() for o in out])))
            kept = [batch.column(c).take(pa.array(order)) for c in ("design_id", "seq", "target_w")]
            yield pa.RecordBatch.from_arrays([*kept, places], ["design_id", "seq", "target_w", "places"])
