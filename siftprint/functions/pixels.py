"""NumPy kernels over stacks of gray images: box and Lanczos resizing, gray, hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..errors import InvalidInput

MAX_SIDE = 64


def target_size(algorithm: str, side: int) -> tuple[int, int]:
    """Width and height that an algorithm hashes at."""
    check_side(side)
    extra = {"mean": (0, 0), "median": (0, 0), "block": (0, 0), "gradient": (0, 1), "vert_gradient": (1, 0), "double_gradient": (1, 1)}
    if algorithm not in extra:
        raise InvalidInput(f"no algorithm {algorithm!r}; there are {', '.join(extra)}")
    return side + extra[algorithm][0], side + extra[algorithm][1]


def check_side(side: int) -> None:
    if not isinstance(side, int) or not 1 <= side <= MAX_SIDE:
        raise InvalidInput(f"the side is from 1 to {MAX_SIDE}, not {side!r}")


def n_words(side: int) -> int:
    """64-bit words of a hash."""
    return -(-side * side // 64)


def _edges(src: int, dst: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the cells; in double precision, as the results depend on its rounding."""
    ratio = src / dst
    d = np.arange(dst, dtype=np.float64)
    return np.floor(d * ratio).astype(np.int64), np.floor(np.minimum((d + 1) * ratio, src)).astype(np.int64)


def resize_box(stack: np.ndarray, width: int, height: int) -> np.ndarray:
    """Truncated means over cells; an empty cell (a larger target) is 0. stack: images, rows, columns."""
    n, h, w = stack.shape
    if (w, h) == (width, height):
        return stack
    x0, x1 = _edges(w, width)
    y0, y1 = _edges(h, height)
    rows = np.zeros((n, height, w + 1), np.int64)  # wide numbers for the target's rows only, not for each pixel
    for i, (a, z) in enumerate(zip(y0, y1, strict=True)):
        stack[:, a:z].sum(1, np.int64, rows[:, i, 1:])
    rows.cumsum(2, out=rows)
    total = rows[:, :, x1] - rows[:, :, x0]
    area = np.maximum(1, np.outer(y1 - y0, x1 - x0))
    return (total // area).astype(np.uint8)


def _lanczos_weights(src: int, dst: int, lobes: int = 3) -> np.ndarray:
    """A row of weights for each target position."""
    scale = max(src / dst, 1.0)
    centre = (np.arange(dst) + 0.5) * src / dst
    x = (np.arange(src) + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def resize_lanczos(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Three-lobed Lanczos resampling of rows, columns (and channels), rounded and clamped."""
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image
    out = np.tensordot(_lanczos_weights(h, height), image.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(_lanczos_weights(w, width), out, (1, 1)), 0, 1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def to_gray(image: np.ndarray, order: str = "BGR") -> np.ndarray:
    """Luma by the integer weights 2126, 7152 and 722 of 10000 for red, green and blue."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    r, g, b = (image[..., order.index(c)].astype(np.int64) for c in "RGB")
    return ((2126 * r + 7152 * g + 722 * b) // 10000).astype(np.uint8)


def _across(stack: np.ndarray) -> np.ndarray:
    return (stack[:, :, 1:] > stack[:, :, :-1]).reshape(len(stack), -1)


def _down(stack: np.ndarray) -> np.ndarray:
    return (stack[:, 1:] > stack[:, :-1]).transpose(0, 2, 1).reshape(len(stack), -1)


def _mean(stack: np.ndarray, side: int) -> np.ndarray:
    p = stack.reshape(len(stack), -1).astype(np.int64)
    return p * p.shape[1] >= p.sum(1, keepdims=True)


def _median(stack: np.ndarray, side: int) -> np.ndarray:
    p = stack.reshape(len(stack), -1)
    return p > np.sort(p, 1)[:, p.shape[1] // 2, None]


def _gradient(stack: np.ndarray, side: int) -> np.ndarray:
    return _across(stack)


def _vert_gradient(stack: np.ndarray, side: int) -> np.ndarray:
    return _down(stack)


def _double_gradient(stack: np.ndarray, side: int) -> np.ndarray:
    return np.concatenate([_across(stack)[:, : side * side // 2], _down(stack)], 1)


def _block(stack: np.ndarray, side: int) -> np.ndarray:
    n, h, w = stack.shape
    if w < side or h < side:
        raise InvalidInput(f"{w} by {h} pixels have no {side} by {side} blocks")
    bh, bw = h // side, w // side
    m = stack[:, : bh * side, : bw * side].reshape(n, side, bh, side, bw).astype(np.int64).sum((2, 4)) // (bh * bw)
    return np.concatenate([_across(m), (m[:, 1:] > m[:, :-1]).reshape(n, -1)], 1)


#: Comparisons by algorithm, in bit order; what is over side * side is cut off.
KERNELS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"mean": _mean, "median": _median, "gradient": _gradient, "vert_gradient": _vert_gradient, "double_gradient": _double_gradient, "block": _block}


def hash_words(stack: np.ndarray, algorithm: str, side: int) -> np.ndarray:
    """Hashes of a stack as signed words, images by words; bit k is bit k % 64 of word k // 64."""
    check_side(side)
    bits = KERNELS[algorithm](stack, side)[:, : side * side]
    full = np.zeros((len(stack), n_words(side) * 64), np.uint8)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<i8")
