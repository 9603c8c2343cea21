"""Vectorised block encoders on NumPy arrays: a raster to the bytes of a strip, all blocks at once. Decoding and the other
formats are done by Columns (operators/packed, packing, blocks, bc7).

A raster is an array (rows, width, channels) of uint8, uint16 or float32.
"""

from __future__ import annotations

import numpy as np

from texloom.functions import bc_tables

TYPES = {"u8": np.uint8, "u16": np.uint16, "f32": np.float32}
ONE = {"u8": 255, "u16": 65535, "f32": 1.0}


def scaled(x: np.ndarray, bits: int, to: int) -> np.ndarray:
    """round(x * (2^to - 1) / (2^bits - 1))"""
    top = (1 << bits) - 1
    return (x.astype(np.uint64) * np.uint64(2 * ((1 << to) - 1)) + np.uint64(top)) // np.uint64(2 * top)


def real(x: np.ndarray, precision: str) -> np.ndarray:
    """Numbers in [0, 1] in a precision, rounded."""
    return x.astype(np.float32) if precision == "f32" else np.floor(np.clip(x, 0, 1) * x.dtype.type(ONE[precision]) + x.dtype.type(0.5)).astype(TYPES[precision])


def unit(x: np.ndarray) -> np.ndarray:
    """Any precision as float64 with 1 for one."""
    return x.astype(np.float64) / {np.dtype(np.uint8): 255.0, np.dtype(np.uint16): 65535.0}.get(x.dtype, 1.0)


def convert(raster: np.ndarray, source: str, channels: str, precision: str) -> np.ndarray:
    """Channels and precision of a raster; gray is red alone, missing alpha is one, missing colour zero."""
    now = precision_of(raster)
    if now != precision:
        if now == "u8" and precision == "u16":
            raster = scaled(raster, 8, 16).astype(np.uint16)
        elif now == "u16" and precision == "u8":
            raster = scaled(raster, 16, 8).astype(np.uint8)
        else:
            raster = real(np.nan_to_num(unit(raster)), precision) if precision != "f32" else unit(raster).astype(np.float32)
    if source == channels:
        return raster
    one, shape = ONE[precision], raster.shape[:2]
    blank = np.zeros((*shape, 3), raster.dtype)
    colour = blank if source == "alpha" else np.repeat(raster, 3, 2) if source == "grayscale" else raster[..., :3]
    alpha = raster[..., -1:] if source in ("alpha", "rgba") else np.full((*shape, 1), one, raster.dtype)
    return {"grayscale": colour[..., :1], "alpha": alpha, "rgb": colour, "rgba": np.concatenate([colour, alpha], 2)}[channels]


# -- blocks ------------------------------------------------------------------------------------------------------------


def bc1_colours(block: np.ndarray, force_four: bool) -> np.ndarray:
    """(n, 8) bytes to (n, 16, 4) RGBA."""
    words = block[:, :4].copy().view("<u2").astype(np.int64)
    index = (block[:, 4:8].copy().view("<u4").astype(np.int64) >> (2 * np.arange(16))) & 3
    four = np.ones(len(block), bool) if force_four else words[:, 0] > words[:, 1]
    palette = np.zeros((len(block), 4, 4), np.int64)
    palette[..., 3] = 255
    palette[~four, 3, 3] = 0
    for c, (low, top) in enumerate(((11, 31), (5, 63), (0, 31))):
        a, b = (words[:, 0] >> low) & top, (words[:, 1] >> low) & top
        over = lambda x, d: (x * 510 + top * d) // (2 * top * d)
        palette[:, 0, c], palette[:, 1, c] = over(a, 1), over(b, 1)
        palette[:, 2, c] = np.where(four, over(2 * a + b, 3), over(a + b, 2))
        palette[:, 3, c] = np.where(four, over(a + 2 * b, 3), 0)
    return np.take_along_axis(palette, index[..., None], 1).astype(np.uint8)


# -- encoding ----------------------------------------------------------------------------------------------------------


def _cells(raster: np.ndarray) -> np.ndarray:
    """(rows, width, c) to (n, 16, c): short block rows repeat their last pixel, missing rows their block's first row."""
    rows, width = raster.shape[:2]
    across, down = -(-width // 4), -(-rows // 4)
    raster = np.concatenate([raster, np.repeat(raster[:, -1:], across * 4 - width, 1)], 1)
    if short := down * 4 - rows:
        raster = np.concatenate([raster, np.repeat(raster[(down - 1) * 4 :][:1], short, 0)], 0)
    return raster.reshape(down, 4, across, 4, -1).swapaxes(1, 2).reshape(down * across, 16, -1)


def encode_bc4(values: np.ndarray, signed: bool) -> np.ndarray:
    """(n, 16) in [0, 1] to (n, 8) bytes: both palettes between the extremes, the better one."""
    top = 254 if signed else 255
    code = np.clip(values, 0, 1) * top
    best, error = None, None
    inner = np.where((code > 0.5) & (code < top - 0.5), code, np.nan)
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            low2, high2 = np.nanmin(inner, 1), np.nanmax(inner, 1)
    low2, high2 = np.where(np.isnan(low2), 0, low2), np.where(np.isnan(high2), 0, high2)
    for wide, (lo, hi) in ((True, (code.min(1), code.max(1))), (False, (low2, high2))):
        lo, hi = np.floor(lo + 0.5).astype(np.int64), np.floor(hi + 0.5).astype(np.int64)
        first, second = (hi, lo) if wide else (lo, hi)
        ramp = [first, second, *((first * (7 - i) + second * i) / 7 for i in range(1, 7))] if wide else [first, second, *((first * (5 - i) + second * i) / 5 for i in range(1, 5)), np.zeros(len(lo)), np.full(len(lo), top)]
        palette = np.stack(ramp, 1)
        # equal ends select the other palette; every index 0 shows the value in both
        distance = (code[:, :, None] - palette[:, None, :]) ** 2
        if wide:
            distance[first == second, :, 1:] = np.inf
        index, cost = distance.argmin(2), distance.min(2).sum(1)
        ends = np.stack([first, second], 1)
        packed = (index.astype(np.uint64) << (np.uint64(3) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
        stored = ((ends - 127) % 256 if signed else ends).astype(np.uint8)
        block = np.concatenate([stored, packed[:, None].view(np.uint8).reshape(-1, 8)[:, :6]], 1)
        if best is None:
            best, error = block, cost
        else:
            take = cost < error
            best[take] = block[take]
    return best


def encode_bc1(rgb: np.ndarray, clear: np.ndarray | None = None, four_only: bool = False) -> np.ndarray:
    """(n, 16, 3) in [0, 1] to (n, 8) bytes: principal axis, then two rounds of least squares; `clear` pixels are transparent."""
    n = len(rgb)
    clear = np.zeros((n, 16), bool) if clear is None else clear
    solid = ~clear
    count = np.maximum(solid.sum(1), 1)[:, None]
    mean = (rgb * solid[..., None]).sum(1) / count
    centred = (rgb - mean[:, None]) * solid[..., None]
    axis = np.ones((n, 3))
    covariance = np.einsum("npi,npj->nij", centred, centred)
    for _ in range(6):
        axis = np.einsum("nij,nj->ni", covariance, axis) + 1e-12
        axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    t = np.einsum("npi,ni->np", centred, axis)
    low, high = np.where(solid, t, np.inf).min(1), np.where(solid, t, -np.inf).max(1)
    low, high = np.where(np.isfinite(low), low, 0), np.where(np.isfinite(high), high, 0)
    a, b = mean + axis * high[:, None], mean + axis * low[:, None]
    three = clear.any(1) & (not four_only)
    levels = np.array([31, 63, 31])
    best, error = np.zeros((n, 8), np.uint8), np.full(n, np.inf)
    for _ in range(3):
        q0, q1 = (np.floor(np.clip(x, 0, 1) * levels + 0.5).astype(np.int64) for x in (a, b))
        w0, w1 = (q[:, 0] << 11 | q[:, 1] << 5 | q[:, 2] for q in (q0, q1))
        swap = np.where(three, w0 > w1, w0 < w1)
        w0, w1 = np.where(swap, w1, w0), np.where(swap, w0, w1)
        block = np.zeros((n, 8), np.uint8)
        block[:, :4] = np.stack([w0, w1], 1).astype("<u2").view(np.uint8)
        trial = np.repeat(block, 4, 0)
        trial[:, 4:] = np.tile(np.array([[0], [0x55], [0xAA], [0xFF]], np.uint8), (n, 4))
        palette = bc1_colours(trial, four_only)[:, 0].reshape(n, 4, 4)
        distance = ((rgb[:, :, None] - palette[:, None, :, :3] / 255) ** 2).sum(-1)
        distance[(palette[..., 3] == 0)[:, None, :].repeat(16, 1)] = np.inf
        index = np.where(clear & three[:, None], 3, distance.argmin(2))
        cost = np.where(clear, 0, np.minimum(distance.min(2), 1e9)).sum(1)
        packed = (index.astype(np.uint64) << (np.uint64(2) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
        block[:, 4:] = packed.astype("<u4").view(np.uint8).reshape(-1, 4)
        better = cost < error
        best[better], error[better] = block[better], cost[better]
        share = np.where(three[:, None], np.array([1, 0, 0.5, 0])[index], np.array([1, 0, 2 / 3, 1 / 3])[index]) * solid
        rest = (1 - share) * solid
        aa, ab, bb = (share**2).sum(1), (share * rest).sum(1), (rest**2).sum(1)
        det = aa * bb - ab * ab
        ax, bx = np.einsum("np,npi->ni", share, rgb), np.einsum("np,npi->ni", rest, rgb)
        ok = np.abs(det) > 1e-9
        safe = np.where(ok, det, 1)[:, None]
        a = np.where(ok[:, None], (ax * bb[:, None] - bx * ab[:, None]) / safe, mean)
        b = np.where(ok[:, None], (bx * aa[:, None] - ax * ab[:, None]) / safe, mean)
    return best


def encode_bc7(rgba: np.ndarray) -> np.ndarray:
    """(n, 16, 4) in [0, 1] to (n, 16) bytes of mode 6: principal axis and one least-squares round, every pair of p-bits tried."""
    n = len(rgba)
    mean = rgba.mean(1)
    centred = rgba - mean[:, None]
    covariance = np.einsum("npi,npj->nij", centred, centred)
    axis = np.ones((n, 4))
    for _ in range(6):
        axis = np.einsum("nij,nj->ni", covariance, axis) + 1e-12
        axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    t = np.einsum("npi,ni->np", centred, axis)
    a, b = mean + axis * t.min(1)[:, None], mean + axis * t.max(1)[:, None]
    weights = np.array(bc_tables.WEIGHTS[4])
    best, error = np.zeros((n, 128), np.uint8), np.full(n, np.inf)
    for _ in range(2):
        last = None
        for p0 in (0, 1):
            for p1 in (0, 1):
                e0, e1 = (np.clip(np.floor((np.clip(x, 0, 1) * 255 - p) / 2 + 0.5), 0, 127).astype(np.int64) * 2 + p for x, p in ((a, p0), (b, p1)))
                palette = ((64 - weights)[None, :, None] * e0[:, None] + weights[None, :, None] * e1[:, None] + 32) >> 6
                distance = ((rgba[:, :, None] * 255 - palette[:, None]) ** 2).sum(-1)
                index, cost = distance.argmin(2), distance.min(2).sum(1)
                flip = index[:, 0] >= 8  # the first index has no high bit: turn the line round
                f0, f1 = np.where(flip[:, None], e1, e0), np.where(flip[:, None], e0, e1)
                turned = np.where(flip[:, None], 15 - index, index)
                bits = np.zeros((n, 128), np.uint8)
                bits[:, 6] = 1
                for c in range(4):
                    for k in range(7):
                        bits[:, 7 + 14 * c + k] = f0[:, c] >> (k + 1) & 1
                        bits[:, 14 + 14 * c + k] = f1[:, c] >> (k + 1) & 1
                bits[:, 63], bits[:, 64] = f0[:, 0] & 1, f1[:, 0] & 1
                for i in range(16):
                    for k in range(3 if i == 0 else 4):
                        bits[:, (65 if i == 0 else 64 + 4 * i) + k] = turned[:, i] >> k & 1
                better = cost < error
                best[better], error[better] = bits[better], cost[better]
                last = index if last is None else np.where(better[:, None], index, last)
        share = weights[last] / 64
        aa, ab, bb = ((1 - share) ** 2).sum(1), ((1 - share) * share).sum(1), (share**2).sum(1)
        det = aa * bb - ab * ab
        ok = np.abs(det) > 1e-9
        ax, bx = np.einsum("np,npi->ni", 1 - share, rgba), np.einsum("np,npi->ni", share, rgba)
        safe = np.where(ok, det, 1)[:, None]
        a = np.where(ok[:, None], (ax * bb[:, None] - bx * ab[:, None]) / safe, mean)
        b = np.where(ok[:, None], (bx * aa[:, None] - ax * ab[:, None]) / safe, mean)
    return np.packbits(best, axis=1, bitorder="little")


def precision_of(raster: np.ndarray) -> str:
    return {np.dtype(np.uint8): "u8", np.dtype(np.uint16): "u16"}.get(raster.dtype, "f32")


def encode(name: str, raster: np.ndarray, channels: str) -> bytes:
    """A raster of any channels and precision as the bytes of a block format."""
    rgba = unit(convert(raster, channels, "rgba", precision_of(raster)))
    cells = _cells(rgba)
    cells = np.clip(np.where(np.isnan(cells), 0, cells), 0, 1)  # one bad pixel must not spoil its block
    if name == "BC1_UNORM":
        return encode_bc1(cells[..., :3], cells[..., 3] < 0.5).tobytes()
    if name.startswith("BC4"):
        return encode_bc4(cells[..., 0], "SNORM" in name).tobytes()
    if name.startswith("BC5"):
        return np.concatenate([encode_bc4(cells[..., c], "SNORM" in name) for c in (0, 1)], 1).tobytes()
    if name == "BC7_UNORM":
        return encode_bc7(np.clip(cells, 0, 1)).tobytes()
    if name in ("BC3_UNORM_RXGB", "BC3_UNORM_NORMAL"):
        alpha, cells = cells[..., 0], np.concatenate([np.ones_like(cells[..., :1]), cells[..., 1:2], np.zeros_like(cells[..., :1]) if name.endswith("NORMAL") else cells[..., 2:3]], -1)
    elif name.startswith(("BC2", "BC3")):
        alpha = cells[..., 3]
        if "PREMULTIPLIED" in name:
            cells = np.clip(cells, 0, 1) * np.clip(cells[..., 3:], 0, 1)
    else:
        raise NotImplementedError(name)
    colour = encode_bc1(np.clip(cells[..., :3], 0, 1), None, True)
    if name.startswith("BC2"):
        codes = np.floor(np.clip(alpha, 0, 1) * 15 + 0.5).astype(np.uint8)
        return np.concatenate([codes[:, ::2] | codes[:, 1::2] << 4, colour], 1).tobytes()
    return np.concatenate([encode_bc4(alpha, False), colour], 1).tobytes()
