"""A plain NumPy decoder, independent of the library's Columns: what tests hold encoders, regions and blocks against."""

import numpy as np
from functools import lru_cache

from texloom.functions import bc_tables
from texloom.functions.formats import pixel_info
from tests.plain_encode import HALF, NATIVE, PAIRS, fields
from texloom.functions.kernels import TYPES, bc1_colours, real, scaled

TO_RGB = ((1.164383, 0.0, 1.596027), (1.164383, -0.391762, -0.812968), (1.164383, 2.017232, 0.0))


def unsigned(x: np.ndarray, bits: int, to: int) -> np.ndarray:
    """A stored SNORM number in the unsigned range."""
    half, top = 1 << (bits - 1), (1 << bits) - 2
    code = np.maximum((x.astype(np.int64) + half) % (2 * half) - 1, 0)
    return (code * (2 * ((1 << to) - 1)) + top) // (2 * top)


def small_float(x: np.ndarray, mantissa: int) -> np.ndarray:
    """Unsigned floats of five exponent bits are halves without a sign and with fewer bits below."""
    return (x.astype(np.uint16) << np.uint16(10 - mantissa)).view(np.float16).astype(np.float32)


def yuv_to_rgb(yuv: np.ndarray, bits: int, precision: str) -> np.ndarray:
    """Limited-range YUV codes of `bits` bits as RGB, in single precision."""
    f, step = np.float32, 1 << (bits - 8)
    y, u, v = (yuv[..., i].astype(f) - f(zero * step) for i, zero in enumerate((16, 128, 128)))
    rgb = np.stack([f(a) * y + f(b) * u + f(c) * v for a, b, c in TO_RGB], -1)
    if bits == 8 and precision == "u8":
        return np.clip(np.floor(rgb + f(0.5)), 0, 255).astype(np.uint8)
    return real(np.clip(rgb * (f(1) / f((1 << bits) - 1)), 0, 1), precision)


def _lanes(name: str, data: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Stored numbers of each channel of a packed format."""
    spec = fields(name)
    if all(bits == spec[0][1] and bits in (8, 16, 32) for _, bits, _ in spec):
        lanes = data.view(f"<u{spec[0][1] // 8}").reshape(n, len(spec))
        return {c: lanes[:, i] for i, (c, _, _) in enumerate(spec)}
    word = data.view(f"<u{pixel_info(name)[1]}").astype(np.uint64)
    return {c: (word >> np.uint64(at)) & np.uint64((1 << bits) - 1) for c, bits, at in spec}


def _packed(name: str, data: np.ndarray, n: int) -> np.ndarray:
    channels, precision = NATIVE[name]
    if name == "R9G9B9E5_SHAREDEXP":
        w = data.view("<u4").astype(np.int64)
        return np.stack([((w >> at) & 511) * np.exp2(((w >> 27) & 31) - 24.0) for at in (0, 9, 18)], 1).astype(np.float32)
    if name in ("AYUV", "Y410", "Y416"):
        bits, order = {"AYUV": (8, "VUYA"), "Y410": (10, "UYVA"), "Y416": (16, "UYVA")}[name]
        if name == "Y410":
            w = data.view("<u4").astype(np.int64)
            lanes = {c: (w >> at) & m for c, at, m in (("U", 0, 1023), ("Y", 10, 1023), ("V", 20, 1023), ("A", 30, 3))}
        else:
            table = data.view(f"<u{bits // 8}").reshape(n, 4)
            lanes = {c: table[:, i] for i, c in enumerate(order)}
        rgb = yuv_to_rgb(np.stack([lanes[c] for c in "YUV"], 1), bits, precision)
        alpha = scaled(lanes["A"], 2 if name == "Y410" else bits, 8 if precision == "u8" else 16).astype(TYPES[precision])
        return np.concatenate([rgb, alpha[:, None]], 1)
    lanes, spec = _lanes(name, data, n), {c: b for c, b, _ in fields(name)}
    to = 8 if precision == "u8" else 16

    def one(c: str) -> np.ndarray:
        x, bits = lanes[c], spec[c]
        if "XR_BIAS" in name and c != "A":
            return (x.astype(np.float32) - np.float32(384)) * (np.float32(1) / np.float32(510))
        if "XR_BIAS" in name:
            return (x.astype(np.float32) / 3).astype(np.float32)
        if "FLOAT" in name:
            return x.astype(np.uint32).view(np.float32) if bits == 32 else x.astype(np.uint16).view(np.float16).astype(np.float32) if bits == 16 else small_float(x, bits - 5)
        return (unsigned(x, bits, to) if "SNORM" in name else scaled(x, bits, to)).astype(TYPES[precision])

    wanted = {"grayscale": "R", "alpha": "A", "rgb": "RGB", "rgba": "RGBA"}[channels]
    blank = HALF[precision] if "SNORM" in name else 0
    return np.stack([one(c) if c in lanes else np.full(n, blank, TYPES[precision]) for c in wanted], 1)


def _sub_sampled(name: str, data: np.ndarray, width: int, rows: int) -> np.ndarray:
    if name == "R1_UNORM":
        bits = np.unpackbits(data.reshape(rows, -1), axis=1)[:, :width]
        return (bits * np.uint8(255))[..., None]
    wide = name in ("Y210", "Y216")
    table = data.view("<u2" if wide else "u1").reshape(rows, -1, 4)
    a, b, c, d = (table[..., i] for i in PAIRS[name])
    first, second = np.stack([a, c, d], -1), np.stack([b, c, d], -1)
    both = np.stack([first, second], 2).reshape(rows, -1, 3)[:, :width]
    if "UNORM" in name:
        return both[..., [1, 0, 2]]  # green alternates, red and blue are shared
    bits = {"Y210": 10, "Y216": 16}.get(name, 8)
    return yuv_to_rgb(both >> 6 if bits == 10 else both, bits, "u16" if wide else "u8")


def _bi_planar(name: str, data: np.ndarray, width: int, rows: int) -> np.ndarray:
    wide = name != "NV12"
    samples = data.view("<u2" if wide else "u1")
    luma = samples[: width * rows].reshape(rows, width)
    chroma = samples[width * rows :].reshape((rows + 1) // 2, (width + 1) // 2, 2)
    up = chroma.repeat(2, 0).repeat(2, 1)[:rows, :width]
    yuv = np.concatenate([luma[..., None], up], 2)
    bits = {"P010": 10, "P016": 16}.get(name, 8)
    return yuv_to_rgb(yuv >> 6 if bits == 10 else yuv, bits, "u16" if wide else "u8")


def bc4_values(block: np.ndarray, signed: bool) -> np.ndarray:
    """(n, 8) bytes to (n, 16) 8-bit values."""
    a, b = block[:, 0].astype(np.int64), block[:, 1].astype(np.int64)
    if signed:
        a, b = block[:, 0].view(np.int8).astype(np.int64), block[:, 1].view(np.int8).astype(np.int64)
    wide = a > b
    if signed:
        a, b = np.maximum(a + 127, 0), np.maximum(b + 127, 0)
    top = 254 if signed else 255
    palette = np.zeros((len(block), 8), np.int64)
    for k in range(8):
        w7, w5 = (0 if k == 0 else 7 if k == 1 else k - 1), (0 if k == 0 else 5 if k == 1 else k - 1)
        far = ((a * (7 - w7) + b * w7) * 510 + top * 7) // (2 * top * 7)
        close = ((a * (5 - w5) + b * w5) * 510 + top * 5) // (2 * top * 5) if k < 6 else np.full(len(block), 255 * (k - 6))
        palette[:, k] = np.where(wide, far, close)
    packed = np.zeros(len(block), np.uint64)
    for i in range(6):
        packed |= block[:, 2 + i].astype(np.uint64) << np.uint64(8 * i)
    index = ((packed[:, None] >> (np.uint64(3) * np.arange(16, dtype=np.uint64))) & np.uint64(7)).astype(np.int64)
    return np.take_along_axis(palette, index, 1).astype(np.uint8)


def bits_of(block: np.ndarray) -> np.ndarray:
    """(n, 16) bytes to (n, 128) bits, low bits first."""
    return np.unpackbits(block, axis=1, bitorder="little").astype(np.int64)


def number(bits: np.ndarray, at: int, n: int) -> np.ndarray:
    return bits[:, at : at + n] @ (1 << np.arange(n)) if n else np.zeros(len(bits), np.int64)


@lru_cache(maxsize=1)
def _partitions() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of subsets: the subset of each pixel, and the pixels with an implicit index bit, by partition."""
    grid = lambda table: np.array([[int(c) for c in row] for row in table])
    return {1: (np.zeros((1, 16), int), np.zeros((1, 1), int)), 2: (grid(bc_tables.TWO), np.array([[0, f] for f in bc_tables.FIX_TWO])), 3: (grid(bc_tables.THREE), np.array([[0, *f] for f in bc_tables.FIX_THREE]))}


def _indices(bits: np.ndarray, at: int, width: int, fixed: np.ndarray) -> np.ndarray:
    """(n, 16) indices; those of the `fixed` pixels (n, k) have one bit less."""
    short = np.zeros((len(bits), 16), bool)
    np.put_along_axis(short, fixed, True, 1)
    starts = at + np.arange(16) * width - (np.cumsum(short, 1) - short)
    out = np.zeros((len(bits), 16), np.int64)
    for k in range(width):
        bit = np.take_along_axis(bits, np.minimum(starts + k, 127), 1)
        out |= np.where(short & (k == width - 1), 0, bit) << k
    return out


def bc7_colours(block: np.ndarray) -> np.ndarray:
    """(n, 16) bytes to (n, 16, 4) RGBA; the blocks of a mode are decoded together, the reserved mode is zero."""
    bits = bits_of(block)
    mode = np.where(bits[:, :8].any(1), bits[:, :8].argmax(1), 8)
    out = np.zeros((len(block), 16, 4), np.uint8)
    for m, (subsets, partition_bits, rotation_bits, switch_bits, colour_bits, alpha_bits, p_kind, index_bits, second_bits) in enumerate(bc_tables.BC7_MODES):
        rows = np.flatnonzero(mode == m)
        if not len(rows):
            continue
        b, at = bits[rows], m + 1
        partition = number(b, at, partition_bits)
        at += partition_bits
        rotation = number(b, at, rotation_bits)
        at += rotation_bits
        switch = number(b, at, switch_bits)
        at += switch_bits
        ends = np.full((len(rows), subsets, 2, 4), 255, np.int64)
        for c in range(4 if alpha_bits else 3):
            width = alpha_bits if c == 3 else colour_bits
            for s in range(subsets):
                for e in range(2):
                    ends[:, s, e, c] = number(b, at, width)
                    at += width
        for c in range(4 if alpha_bits else 3):
            width = alpha_bits if c == 3 else colour_bits
            if p_kind:
                for s in range(subsets):
                    for e in range(2):
                        ends[:, s, e, c] = ends[:, s, e, c] * 2 + b[:, at + (s if p_kind == 2 else 2 * s + e)]
                width += 1
            raised = ends[..., c] << (8 - width)
            ends[..., c] = raised | raised >> width
        at += {0: 0, 1: 2 * subsets, 2: subsets}[p_kind]
        maps, fixes = _partitions()[subsets]
        subset, fixed = maps[partition], fixes[partition]
        index = _indices(b, at, index_bits, fixed)
        at += 16 * index_bits - subsets
        weight = np.array(bc_tables.WEIGHTS[index_bits])[index]
        alpha_weight = weight
        if second_bits:
            other = np.array(bc_tables.WEIGHTS[second_bits])[_indices(b, at, second_bits, fixed)]
            alpha_weight = np.where(switch[:, None] == 1, weight, other)
            weight = np.where(switch[:, None] == 1, other, weight)
        weights = np.stack([weight] * 3 + [alpha_weight], -1)
        e0, e1 = (ends[np.arange(len(rows))[:, None], subset, e] for e in range(2))
        pixels = ((64 - weights) * e0 + weights * e1 + 32) >> 6
        for r in (1, 2, 3):
            turned = np.flatnonzero(rotation == r)
            pixels[np.ix_(turned, range(16), [r - 1, 3])] = pixels[np.ix_(turned, range(16), [3, r - 1])]
        out[rows] = pixels
    return out


def _block_pixels(name: str, block: np.ndarray) -> np.ndarray:
    """(n, bytes) to (n, 16, channels)."""
    if name == "BC1_UNORM":
        return bc1_colours(block, False)
    if name in ("BC4_UNORM", "BC4_SNORM"):
        return bc4_values(block, "SNORM" in name)[..., None]
    if name in ("BC5_UNORM", "BC5_SNORM"):
        signed = "SNORM" in name
        both = np.stack([bc4_values(block[:, :8], signed), bc4_values(block[:, 8:], signed)], -1)
        return np.concatenate([both, np.full((*both.shape[:2], 1), 128 if signed else 0, np.uint8)], -1)
    if name == "BC7_UNORM":
        return bc7_colours(block)
    two = name.startswith("BC2")
    colour = bc1_colours(block[:, 8:], two)
    alpha = ((block[:, :8, None] >> np.array([0, 4])) & 15).reshape(-1, 16) * 17 if two else bc4_values(block[:, :8], False)
    if name == "BC3_UNORM_RXGB" or name == "BC3_UNORM_NORMAL":
        out = np.stack([alpha, colour[..., 1], colour[..., 2]], -1).astype(np.uint8)
        if name.endswith("NORMAL"):
            x, y = out[..., 0] / 127.5 - 1, out[..., 1] / 127.5 - 1
            out[..., 2] = np.floor((np.sqrt(np.maximum(1 - x * x - y * y, 0)) / 2 + 0.5) * 255 + 0.5)
        return out
    out = np.concatenate([colour[..., :3], alpha[..., None]], -1).astype(np.int64)
    if "PREMULTIPLIED" in name:
        out[..., :3] = np.minimum(255, out[..., :3] * 255 // np.where(out[..., 3:] == 0, 255, out[..., 3:]))
    return out.astype(np.uint8)


def decode(name: str, data: bytes, width: int, rows: int) -> np.ndarray:
    """A strip's raster in native channels and precision."""
    kind, size, bw, bh, *_ = pixel_info(name)
    raw = np.frombuffer(data, np.uint8)
    if kind == "fixed":
        return _packed(name, raw, width * rows).reshape(rows, width, -1)
    if kind == "biplanar":
        return _bi_planar(name, raw, width, rows)
    if bh == 1:
        return _sub_sampled(name, raw, width, rows)
    if not name.startswith("BC") or name.startswith("BC6H"):
        raise NotImplementedError(name)
    across, down = -(-width // 4), -(-rows // 4)
    pixels = _block_pixels(name, raw.reshape(across * down, size))
    return pixels.reshape(down, across, 4, 4, -1).swapaxes(1, 2).reshape(down * 4, across * 4, -1)[:rows, :width]
