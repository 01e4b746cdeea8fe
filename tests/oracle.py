"""Plain Python versions of the hashes, loop by loop, from their definitions."""

import math


def resize(p, w, h, tw, th):
    if (w, h) == (tw, th):
        return list(p)
    out = []
    for y in range(th):
        for x in range(tw):
            rx, ry = w / tw, h / th
            x0, x1 = math.floor(x * rx), math.floor(min((x + 1) * rx, w))
            y0, y1 = math.floor(y * ry), math.floor(min((y + 1) * ry, h))
            total = sum(p[j * w + i] for j in range(y0, y1) for i in range(x0, x1))
            out.append(total // max(1, (x1 - x0) * (y1 - y0)))
    return out


def across(p, w, h):
    return [p[r * w + c + 1] > p[r * w + c] for r in range(h) for c in range(w - 1)]


def down(p, w, h):
    return [p[(r + 1) * w + c] > p[r * w + c] for c in range(w) for r in range(h - 1)]


def bits(algorithm, p, w, h, side):
    b, n = side * side, w * h
    if algorithm == "mean":
        out = [v * n >= sum(p) for v in p]
    elif algorithm == "median":
        out = [v > sorted(p)[n // 2] for v in p]
    elif algorithm == "gradient":
        out = across(p, w, h)
    elif algorithm == "vert_gradient":
        out = down(p, w, h)
    elif algorithm == "double_gradient":
        out = across(p, w, h)[: b // 2] + down(p, w, h)
    else:
        bw, bh = w // side, h // side
        m = [sum(p[(y * bh + j) * w + x * bw + i] for j in range(bh) for i in range(bw)) // (bw * bh) for y in range(side) for x in range(side)]
        out = across(m, side, side) + [m[(y + 1) * side + x] > m[y * side + x] for y in range(side - 1) for x in range(side)]
    return out[:b]


def words(algorithm, p, w, h, side):
    out = [0] * -(-side * side // 64)
    for k, bit in enumerate(bits(algorithm, p, w, h, side)):
        out[k // 64] |= int(bit) << k % 64
    return [x - (1 << 64) if x >> 63 else x for x in out]


def lcg(n, seed=12345):
    """Pseudo-random pixels."""
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % 2**32
        out.append((seed >> 16) & 255)
    return out


def hamming(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")
