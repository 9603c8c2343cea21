"""Decoding against plain loops over bits and a plain decoder; error diffusion against a plain loop."""

import numpy as np
import pytest
from tests import plain_decode
from texloom.functions import bc_tables

SF = "/root/testdata/sf0.001"


def bc7_block(data):
    """One BC7 block, bit by bit."""
    stream = int.from_bytes(data, "little")
    at = 0

    def take(n):
        nonlocal at
        at += n
        return (stream >> (at - n)) & ((1 << n) - 1)

    mode = next((m for m in range(8) if data[0] >> m & 1), None)
    if mode is None:
        return [(0, 0, 0, 0)] * 16
    take(mode + 1)
    subsets, pb, rb, sb, cb, ab, p_kind, ib, ib2 = bc_tables.BC7_MODES[mode]
    part, rotation, switch = take(pb), take(rb), take(sb)
    ends = [[take(cb) for _ in range(2 * subsets)] for _ in range(3)]
    ends.append([take(ab) for _ in range(2 * subsets)] if ab else [255] * 2 * subsets)
    widths = [cb] * 3 + [ab or 8]
    if p_kind:
        bits = [take(1) for _ in range(2 * subsets if p_kind == 1 else subsets)]
        for c in range(4 if ab else 3):
            ends[c] = [e * 2 + (bits[i] if p_kind == 1 else bits[i // 2]) for i, e in enumerate(ends[c])]
            widths[c] += 1
    full = [[(e << (8 - w)) | (e << (8 - w)) >> w for e in line] for line, w in zip(ends, widths)]
    table = {1: ["0" * 16], 2: bc_tables.TWO, 3: bc_tables.THREE}[subsets]
    fixes = {1: [0], 2: [0, bc_tables.FIX_TWO[part] if subsets == 2 else 0], 3: [0, *(bc_tables.FIX_THREE[part] if subsets == 3 else ())]}[subsets]
    first = [take(ib - (i in fixes)) for i in range(16)]
    second = [take(ib2 - (i == 0)) for i in range(16)] if ib2 else None
    out = []
    for i in range(16):
        s = int(table[part][i])
        w = bc_tables.WEIGHTS[ib][first[i]]
        wa = w
        if second:
            wa = bc_tables.WEIGHTS[ib2][second[i]]
            if switch:
                w, wa = wa, w
        px = [((64 - (wa if c == 3 else w)) * full[c][2 * s] + (wa if c == 3 else w) * full[c][2 * s + 1] + 32) >> 6 for c in range(4)]
        if rotation:
            px[rotation - 1], px[3] = px[3], px[rotation - 1]
        out.append(tuple(px))
    return out


@pytest.mark.parametrize("mode", range(9))
def test_bc7_modes(mode):
    rng = np.random.default_rng(mode)
    blocks = rng.integers(0, 256, (200, 16), np.uint8)
    blocks[:, 0] = 0 if mode == 8 else (blocks[:, 0] >> (mode + 1) << (mode + 1)) | 1 << mode
    got = plain_decode.bc7_colours(blocks)
    for block, pixels in zip(blocks, got):
        assert [tuple(map(int, p)) for p in pixels] == bc7_block(block.tobytes())


def test_bc7_query(spark):
    from texloom.plans import fixtures, texture_queries

    data = {(r.doc_id, r.k): bytes(r.data) for r in fixtures.block_bytes(spark, SF).collect()}
    got = texture_queries.QUERIES["q_bc7_decode"](spark, SF).collect()
    assert len(got) == 16 * len(data)
    want = {key: bc7_block(block) for key, block in data.items()}
    assert all(want[r.doc_id, r.k][r.pixel] == (r.r, r.g, r.b, r.a) for r in got)


def test_bad_strips_give_no_rows(spark):
    from texloom.operators import decode

    frame = spark.createDataFrame([(1, b"abcd", 1, 1), (2, b"abc", 1, 1), (3, None, 1, 1), (4, b"", 0, 0)], "id long, data binary, width int, rows int")
    assert [tuple(r) for r in decode.strip_pixels(frame, "R8G8B8A8_UNORM").collect()] == [(1, 0, 0, 97, 98, 99, 100)]
    assert decode.block_pixels(frame.select("id", "data"), "BC7_UNORM").count() == 0


def test_error_diffusion(spark):
    """Every surface by a plain loop in single precision; the bits keep the mean."""
    from texloom.plans import fixtures, texture_queries

    pixels = {(r.x, r.y): r.r for r in fixtures.pixels(spark, SF).collect()}
    got = {(r.surface, r.x, r.y): r.code for r in texture_queries.QUERIES["q_fs_dither"](spark, SF).collect()}
    assert len(got) == len(pixels)
    for surface in {s for s, _, _ in got}:
        own = {(x, y % 20): v for (x, y), v in pixels.items() if y // 20 == surface}
        w, h = max(x for x, _ in own) + 1, max(y for _, y in own) + 1
        error = np.zeros((h + 1, w + 2), np.float32)
        for (x, y), v in own.items():
            error[y, x + 1] = np.float32(v) / np.float32(255)
        for y in range(h):
            for x in range(w):
                v = error[y, x + 1]
                code = int(np.floor(min(max(v, np.float32(0)), np.float32(1)) + np.float32(0.5)))
                assert got.get((surface, x, y), code) == code
                e = v - np.float32(code)
                for dy, dx, k in ((0, 2, 7), (1, 0, 3), (1, 1, 5), (1, 2, 1)):
                    error[y + dy, x + dx] += e * np.float32(k / 16)
    mean = np.mean(list(pixels.values())) / 255
    assert abs(np.mean(list(got.values())) - mean) < 0.02


def test_what_is_not_decoded_is_refused(spark):
    from texloom.operators import decode

    blocks = spark.createDataFrame([(1, bytes(16))], "id long, data binary")
    for name in ("ASTC_4X4_UNORM", "ASTC_12X12_UNORM", "R8_UNORM"):
        with pytest.raises(NotImplementedError):
            decode.block_pixels(blocks, name)
    for column, name in (("gray", "BC4_UNORM"), ("pixel", "BC7_UNORM"), ("r", "BC1_UNORM")):
        with pytest.raises(ValueError):
            decode.block_pixels(blocks.withColumnRenamed("id", column), name)


@pytest.mark.parametrize("name", ["BC3_UNORM_NORMAL", "BC2_UNORM_PREMULTIPLIED_ALPHA", "BC5_SNORM", "BC7_UNORM", "BC4_UNORM", "BC1_UNORM"])
def test_strips_of_blocks(spark, name):
    """Sizes that end within blocks, by the plain decoder."""
    from texloom.functions.formats import pixel_info
    from texloom.operators import decode

    rng, size = np.random.default_rng(3), pixel_info(name)[1]
    strips = []
    for i, (w, h) in enumerate([(4, 4), (7, 13), (1, 1), (9, 4)]):
        strips.append((i, w, h, rng.integers(0, 256, -(-w // 4) * -(-h // 4) * size, np.uint8).tobytes()))
    got = decode.strip_pixels(spark.createDataFrame(strips, "id long, width long, rows long, data binary"), name)
    want = [(i, x, y, *map(int, plain_decode.decode(name, data, w, h)[y, x])) for i, w, h, data in strips for x in range(w) for y in range(h)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_all_formats_in_one_pass(spark):
    """Random strips of every packed, sub-sampled and bi-planar format in one table, by the plain decoder."""
    from texloom.functions.formats import pixel_info
    from texloom.operators import packed

    rng, strips, want = np.random.default_rng(4), [], []
    for i, name in enumerate(packed.NAMES):
        kind, size, bw, _, p1, p2, *_ = pixel_info(name)
        for w, h in ((6, 2), (4, 4)) if kind == "biplanar" else ((6, 2), (3, 5), (17, 1)):
            n = w * h * size if kind == "fixed" else p1 * w * h + p2 * -(-w // 2) * -(-h // 2) if kind == "biplanar" else -(-w // bw) * h * size
            data = rng.integers(0, 256, n, np.uint8).tobytes()
            strips.append((i, name, w, h, data))
            pixels = plain_decode.decode(name, data, w, h)
            channels, precision = packed.NATIVE[name]
            numbers = np.ascontiguousarray(pixels).view(np.uint32) if precision == "f32" else pixels
            one = packed.TOP[precision]
            for y in range(h):
                for x in range(w):
                    v = [int(c) for c in numbers[y, x]]
                    v = {"grayscale": [*v * 3, one], "alpha": [0, 0, 0, *v], "rgb": [*v, one], "rgba": v}[channels]
                    want.append((i, name, x, y, *v))
    strips.append((99, "BC1_UNORM", 4, 4, bytes(8)))
    strips.append((98, "R8_UNORM", 4, 4, bytes(15)))
    got = packed.strip_pixels(spark.createDataFrame(strips, "id long, format string, width int, rows int, data binary")).collect()
    nan = lambda r: tuple(0x7FC00000 if isinstance(c, int) and "FLOAT" in r[1] and (c & 0x7FFFFFFF) > 0x7F800000 else c for c in r)
    assert sorted(nan(tuple(r)) for r in got) == sorted(map(nan, want))


def test_strips_of_one_size_are_read_together(spark):
    """Equal strips become one batch, whatever lies between them; the fields of the format do not pass through Python."""
    from texloom.functions import units
    from texloom.operators import packed

    rows = [(i, "R8_UNORM" if i % 3 else "NV12", bytes([i % 251] * (6 if i % 3 else 9)), 2 + i % 2, 2) for i in range(400)] + [(900, "R8_UNORM", None, 2, 2), (901, "R8_UNORM", b"", 0, 0), (902, None, b"abcd", 2, 2)]
    frame = spark.createDataFrame(rows, "id int, format string, data binary, width int, rows int").coalesce(1)
    assert units._equal_units(np.frombuffer(b"abcdefgh", np.uint8).reshape(2, 4), 2, 2, 1, 2, 0, 0)[0].tolist() == [97, 98, 99, 100, 101, 102, 103, 104]
    found = packed.strip_pixels(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("MapInArrow") :].split("\n", 1)[0]
    assert "texloom spec" not in sent
    sizes = [tuple(r) for r in found.groupBy("id").count().collect()]
    want = [(i, w * h) for i, name, data, w, h in rows if data and name and len(data) == (w * h if name == "R8_UNORM" else w * h + 2 * -(-w // 2) * -(-h // 2))]
    assert sorted(sizes) == sorted(want)
