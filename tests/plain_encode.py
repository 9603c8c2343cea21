"""Plain NumPy encoders of the packed, sub-sampled and bi-planar formats, to hold the Column forms against."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from texloom.functions import kernels
from texloom.functions.formats import FORMATS, pixel_info

NATIVE = {f[0]: (f[1].lower(), f[2].lower()) for f in FORMATS}
HALF = {"u8": 128, "u16": 32768, "f32": 0.5}

@lru_cache(maxsize=None)
def fields(name: str) -> list[tuple[str, int, int]]:
    """(channel, bits, position) of a packed format, from the lowest bit."""
    at, out = 0, []
    for channel, bits in re.findall(r"([RGBAX])(\d+)", re.sub(r"_XR_BIAS_", "", name)):
        out.append((channel, int(bits), at))
        at += int(bits)
    return out


# The published six-digit coefficients (fixed values): luma, blue and red chroma of each colour.
TO_YUV = ((0.256788, 0.504129, 0.097906), (-0.148223, -0.290993, 0.439216), (0.439216, -0.367788, -0.071427))


def rgb_to_yuv(rgb: np.ndarray, bits: int) -> np.ndarray:
    """RGB, one for one, as limited-range codes, in single precision."""
    rgb = np.where(np.isnan(rgb), 0, rgb)
    f, step, top = np.float32, 1 << (bits - 8), (1 << bits) - 1
    r, g, b = (rgb[..., i].astype(f) * f(top) for i in range(3))
    coded = np.stack([f(x) * r + f(y) * g + f(z) * b + f(zero * step + 0.5) for (x, y, z), zero in zip(TO_YUV, (16, 128, 128), strict=True)], -1)
    return np.clip(np.floor(coded), 0, top).astype(np.int64)


def float_code(x: np.ndarray, mantissa: int) -> np.ndarray:
    """Numbers as unsigned floats of five exponent bits: the mantissa is rounded half up, then the half is cut.

    Below zero is 0, too large is infinite, NaN has all bits; what a half holds as a subnormal is cut after its rounding."""
    x = x.astype(np.float32)
    drop = np.uint32(23 - mantissa)
    positive = np.where(np.isfinite(x) & (x > 0), x, np.float32(0))
    near = (((positive.view(np.uint32) + (np.uint32(1) << (drop - np.uint32(1)))) >> drop) << drop).view(np.float32)
    near = np.where(positive < np.finfo(np.float32).tiny, 0, np.minimum(near, np.float32(2.0**17)))
    with np.errstate(over="ignore"):
        code = near.astype(np.float16).view(np.uint16).astype(np.uint64) >> np.uint64(10 - mantissa)
    code = np.where(x == np.inf, np.uint64(31 << mantissa), code)
    return np.where(np.isnan(x), np.uint64((32 << mantissa) - 1), code)


# Order of samples of sub-sampled formats in a pair of pixels (fixed values): first luma or green, second, and the two shared.
PAIRS = {"R8G8_B8G8_UNORM": (1, 3, 0, 2), "G8R8_G8B8_UNORM": (0, 2, 1, 3), "UYVY": (1, 3, 0, 2), "YUY2": (0, 2, 1, 3), "Y210": (0, 2, 1, 3), "Y216": (0, 2, 1, 3)}


def _encode_packed(name: str, rgba: np.ndarray) -> bytes:
    """rgba: (n, 4) float64, one for one."""
    n = len(rgba)
    code = lambda x, bits: np.floor(np.clip(np.nan_to_num(x), 0, 1) * ((1 << bits) - 1) + 0.5).astype(np.uint64)
    if name in ("AYUV", "Y410", "Y416"):
        bits = {"AYUV": 8, "Y410": 10, "Y416": 16}[name]
        y, u, v = rgb_to_yuv(np.clip(rgba[:, :3], 0, 1), bits).T.astype(np.uint64)
        if name == "Y410":
            return (u | y << np.uint64(10) | v << np.uint64(20) | code(rgba[:, 3], 2) << np.uint64(30)).astype("<u4").tobytes()
        a = code(rgba[:, 3], bits)
        return np.stack([v, u, y, a] if name == "AYUV" else [u, y, v, a], 1).astype(f"<u{bits // 8}").tobytes()
    if name == "R9G9B9E5_SHAREDEXP":
        c = np.clip(np.nan_to_num(rgba[:, :3], nan=0.0, posinf=65408), 0, 65408)
        top = np.maximum(c.max(1), 2.0**-24)
        e = np.maximum(np.floor(np.log2(top)) + 1, -15)
        e = np.where(np.floor(top / np.exp2(e - 9) + 0.5) == 512, e + 1, e)
        m = np.floor(c / np.exp2(e - 9)[:, None] + 0.5).astype(np.uint64)
        return (m[:, 0] | m[:, 1] << np.uint64(9) | m[:, 2] << np.uint64(18) | (e + 15).astype(np.uint64) << np.uint64(27)).astype("<u4").tobytes()
    spec = fields(name)
    lane = dict(zip("RGBA", rgba.T, strict=True))

    def one(c: str, bits: int) -> np.ndarray:
        x = lane.get(c, np.ones(n))
        if "XR_BIAS" in name and c != "A":
            return np.clip(np.floor(np.nan_to_num(x) * 510 + 384.5), 0, 1023).astype(np.uint64)
        if "FLOAT" in name and bits == 32:
            return x.astype(np.float32).view(np.uint32).astype(np.uint64)
        if "FLOAT" in name:
            return x.astype(np.float32).astype(np.float16).view(np.uint16).astype(np.uint64) if bits == 16 else float_code(x, bits - 5)
        if "SNORM" in name:
            top = (1 << bits) - 2
            stored = np.floor(np.clip(np.nan_to_num(x, nan=1.0), 0, 1) * top + 0.5).astype(np.int64) + 1
            return ((stored + (1 << (bits - 1))) % (1 << bits)).astype(np.uint64)
        return code(x, bits)

    if all(bits == spec[0][1] and bits in (8, 16, 32) for _, bits, _ in spec):
        return np.stack([one(c, bits) for c, bits, _ in spec], 1).astype(f"<u{spec[0][1] // 8}").tobytes()
    word = np.zeros(n, np.uint64)
    for c, bits, at in spec:
        word |= one(c, bits) << np.uint64(at)
    return word.astype(f"<u{pixel_info(name)[1]}").tobytes()


def _encode_pairs(name: str, rgb: np.ndarray) -> bytes:
    """rgb: (rows, width, 3) float64; an odd last pixel is its own neighbour."""
    if rgb.shape[1] % 2:
        rgb = np.concatenate([rgb, rgb[:, -1:]], 1)
    wide = name in ("Y210", "Y216")
    if "UNORM" in name:
        rgb = rgb.astype(np.float32)
        mean = (rgb[:, ::2] + rgb[:, 1::2]) * np.float32(0.5)
        shown = np.stack([rgb[:, ::2, 1], rgb[:, 1::2, 1], mean[..., 0], mean[..., 2]], -1)
        codes = np.floor(np.where(np.isnan(shown), 0, shown).clip(0, 1).astype(np.float32) * np.float32(255) + np.float32(0.5))
    else:
        yuv = rgb_to_yuv(rgb.clip(0, 1), 16 if wide else 8)
        shared = (yuv[:, ::2, 1:] + yuv[:, 1::2, 1:]) // 2
        codes = np.stack([yuv[:, ::2, 0], yuv[:, 1::2, 0], shared[..., 0], shared[..., 1]], -1) & (0xFFC0 if name == "Y210" else 0xFFFF)
    out = np.zeros_like(codes)
    for source, place in enumerate(PAIRS[name]):
        out[..., place] = codes[..., source]
    return out.astype("<u2" if wide else "u1").tobytes()


def _encode_planes(name: str, rgb: np.ndarray) -> bytes:
    bits = {"P010": 10, "P016": 16}.get(name, 8)
    rows, width = rgb.shape[:2]
    if rows % 2 or width % 2:
        raise ValueError("4:2:0 surfaces have even sizes")
    yuv = rgb_to_yuv(rgb.clip(0, 1), bits)
    chroma = yuv[..., 1:].reshape(rows // 2, 2, width // 2, 2, 2).sum((1, 3)) // 4
    dtype, up = ("u1", 0) if bits == 8 else ("<u2", 6 if bits == 10 else 0)
    return (yuv[..., 0] << up).astype(dtype).tobytes() + (chroma << up).astype(dtype).tobytes()


def encode(name: str, raster: np.ndarray, channels: str) -> bytes:
    """A raster of any channels and precision as the format's bytes; block formats by the library's own encoders."""
    kind, _, _, high, *_ = pixel_info(name)
    if high == 4:
        return kernels.encode(name, raster, channels)
    rgba = kernels.unit(kernels.convert(raster, channels, "rgba", kernels.precision_of(raster)))
    if kind == "fixed":
        return _encode_packed(name, rgba.reshape(-1, 4))
    if kind == "biplanar":
        return _encode_planes(name, rgba[..., :3])
    if name == "R1_UNORM":
        return np.packbits(rgba[..., 0] >= 0.5, axis=1).tobytes()
    return _encode_pairs(name, rgba[..., :3])
