"""Encoders: exact round trips of the packed formats, error bounds of the block formats, bad strips."""

import numpy as np
import pytest
from tests import plain_decode, plain_encode
from texloom.functions import kernels
from texloom.functions.formats import pixel_info

LOSSLESS = ["R8G8B8A8_UNORM", "B8G8R8A8_UNORM", "R16G16B16A16_UNORM", "R32G32B32A32_FLOAT", "R16G16B16A16_FLOAT", "R16G16B16A16_SNORM"]


def smooth(width, rows, seed=1):
    """A raster whose colours change slowly along a line, as block formats expect."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 256, (2, 4))
    x, y = np.meshgrid(np.linspace(0, 1, width), np.linspace(0, 1, rows))
    return np.floor(a + (b - a) * ((x + y) / 2)[..., None] + 0.5).astype(np.uint8)


@pytest.mark.parametrize("name", LOSSLESS)
def test_eight_bits_survive(name):
    raster = np.random.default_rng(3).integers(0, 256, (5, 7, 4), np.uint8)
    back = plain_decode.decode(name, plain_encode.encode(name, raster, "rgba"), 7, 5)
    assert (kernels.convert(back, "rgba", "rgba", "u8") == raster).all()


@pytest.mark.parametrize("name,channels,bound", [("BC1_UNORM", 3, 5), ("BC2_UNORM", 4, 9), ("BC3_UNORM", 4, 5), ("BC3_UNORM_RXGB", 3, 5), ("BC4_UNORM", 1, 2), ("BC4_SNORM", 1, 2), ("BC5_UNORM", 2, 2), ("BC5_SNORM", 2, 2), ("BC7_UNORM", 4, 2)])
@pytest.mark.parametrize("width,rows", [(16, 16), (13, 7), (1, 1)])
def test_blocks_stay_close(name, channels, bound, width, rows):
    raster = smooth(width, rows)
    if channels == 3:
        raster[..., 3] = 255
    data = plain_encode.encode(name, raster, "rgba")
    assert len(data) == -(-width // 4) * -(-rows // 4) * pixel_info(name)[1]
    back = plain_decode.decode(name, data, width, rows)
    error = np.abs(back[..., :channels].astype(int) - raster[..., :channels].astype(int))
    assert error.mean() <= bound, error.mean()


def test_transparent_pixels_of_bc1():
    raster = smooth(8, 8)
    raster[..., 3] = np.where(np.arange(8) % 3 == 0, 0, 255)
    back = plain_decode.decode("BC1_UNORM", kernels.encode("BC1_UNORM", raster, "rgba"), 8, 8)
    assert (back[..., 3] == raster[..., 3]).all()


def test_shared_exponent_and_small_floats():
    """Every number is within half a step of the nearest; ties go up in the small floats; bounds and NaN as defined."""
    rng = np.random.default_rng(4)
    values = np.concatenate([np.exp2(rng.uniform(-13, 15, 3000)), [0, 1, 33, 65, 1023, 65408]]).astype(np.float32)
    raster = np.repeat(values[None, :, None], 3, 2)
    back = plain_decode.decode("R9G9B9E5_SHAREDEXP", plain_encode.encode("R9G9B9E5_SHAREDEXP", raster, "rgb"), len(values), 1)
    assert (np.abs(back - raster) <= raster / 256 * 0.5 + 2.0**-25).all()
    x = np.array([129, 131, 255, 257, 1, 0, -1, np.inf, np.nan, 0.5, 130], np.float32)
    got = plain_decode.small_float(plain_encode.float_code(x, 6), 6)
    assert np.array_equal(got, np.array([130, 132, 256, 256, 1, 0, 0, np.inf, np.nan, 0.5, 130], np.float32), equal_nan=True)


def test_bad_strips_are_null(spark):
    from texloom.operators import encode

    frame = spark.createDataFrame([(1, b"abcd", 1, 1), (2, b"abc", 1, 1), (3, None, 1, 1), (4, b"", 0, 0)], "id long, data binary, width int, rows int")
    rows = {(r.id, r.format): r.data for r in encode.strips(frame, ["B8G8R8A8_UNORM", "NV12", "R1_UNORM"]).collect()}
    assert len(rows) == 12 and bytes(rows[1, "B8G8R8A8_UNORM"]) == b"cbad" and rows[1, "R1_UNORM"] is not None
    assert all(data is None for (_, name), data in rows.items() if name == "NV12") and all(data is None for (i, _), data in rows.items() if i > 1)


def test_block_strips(spark):
    """The operator gives the kernel's bytes for every strip, and decoding them gives pixels close to the source."""
    from texloom.operators import decode, encode

    sources = {i: smooth(8, 8, i) for i in range(20)}
    frame = spark.createDataFrame([(i, s.tobytes(), 8, 8) for i, s in sources.items()], "id long, data binary, width int, rows int")
    out = encode.strips(frame, ["BC7_UNORM"]).selectExpr("id", "data", "8 AS width", "8 AS rows")
    for r in decode.strip_pixels(out, "BC7_UNORM").collect():
        assert all(abs(int(v) - int(s)) <= 8 for v, s in zip((r.r, r.g, r.b, r.a), sources[r.id][r.y, r.x], strict=True))


def test_block_query(spark):
    """No block is worse than its best single colour, by a search over all of them; alpha of BC2 is the nearest code."""
    from texloom.plans import codec_queries, fixtures

    sf = "/root/testdata/sf0.001"
    source = {}
    for r in fixtures.vectors(spark, sf).collect():
        source.setdefault(r.vec_id, np.zeros((16, 4), int))[r.i] = (r.r, r.g, r.b, r.a)
    rows = codec_queries.QUERIES["q_encode_blocks"](spark, sf).collect()
    assert len(rows) == len(source) * len(codec_queries._BLOCKS)
    steps = [np.floor(np.arange(n) * 255 / (n - 1) + 0.5) for n in (32, 64, 32)]
    flat = lambda px, c, codes: ((px[:, c, None] - codes[None]) ** 2).sum(0).min()
    for r in rows:
        pixels = source[r.vec_id]
        got = plain_decode.decode(r.format, bytes.fromhex(r.block), 4, 4).reshape(16, -1).astype(int)
        error = ((got - pixels[:, : got.shape[1]]) ** 2).sum(0)
        if r.format.startswith(("BC4", "BC5")):
            top = 1 if r.format.startswith("BC4") else 2
            assert all(error[c] <= flat(pixels, c, np.arange(256)) for c in range(top))
        elif r.format == "BC7_UNORM":
            assert error.sum() <= sum(flat(pixels, c, np.arange(256)) for c in range(4)) + 16 * 4
        elif "PREMULTIPLIED" not in r.format and r.format not in ("BC3_UNORM_NORMAL", "BC3_UNORM_RXGB") and not (r.format == "BC1_UNORM" and (pixels[:, 3] < 128).any()):
            assert error[:3].sum() <= sum(flat(pixels, c, steps[c]) for c in range(3)) + 1
        if r.format == "BC2_UNORM":
            assert (got[:, 3] == np.floor(pixels[:, 3] / 17 + 0.5) * 17).all()


@pytest.mark.parametrize("name", ["BC1_UNORM", "BC7_UNORM", "YUY2", "R1_UNORM", "R8G8_UNORM", "NV12"])
def test_strips_of_mixed_sizes(spark, name):
    """Encoding a batch gives each strip the bytes it has alone, whatever lies beside it."""
    from texloom.operators import encode

    sizes = [(8, 8), (5, 3), (8, 8), (4, 4), (5, 3), (6, 4), (8, 8)]
    sources = {i: smooth(w, h, i) for i, (w, h) in enumerate(sizes)}
    frame = spark.createDataFrame([(i, s.tobytes(), s.shape[1], s.shape[0]) for i, s in sources.items()], "id long, data binary, width int, rows int").coalesce(1)
    for r in encode.strips(frame, [name]).collect():
        odd = name == "NV12" and (sources[r.id].shape[0] % 2 or sources[r.id].shape[1] % 2)
        assert r.data is None if odd else bytes(r.data) == plain_encode.encode(name, sources[r.id], "rgba")


@pytest.mark.parametrize("name", ["BC1_UNORM", "BC2_UNORM", "BC3_UNORM", "BC4_UNORM", "BC5_UNORM", "BC7_UNORM"])
@pytest.mark.parametrize("bad", [np.nan, np.inf, -np.inf])
def test_one_bad_pixel_spoils_no_block(name, bad):
    raster = np.zeros((4, 4, 4), np.float32)
    raster[..., 0] = raster[..., 3] = 1
    raster[2, 1] = bad
    back = plain_decode.decode(name, plain_encode.encode(name, raster, "rgba"), 4, 4).astype(int)
    red = np.delete(back.reshape(16, -1)[:, 0], 9)
    assert (red >= 248).all()


@pytest.mark.parametrize("channels,precision", [("rgba", "u8"), ("rgb", "u16"), ("grayscale", "u8"), ("alpha", "u16"), ("rgba", "f32")])
def test_columns_equal_the_plain_encoder(spark, channels, precision):
    """All packed, sub-sampled and bi-planar formats, from any source, odd sizes, numbers beyond the range, infinities and NaN."""
    from texloom.operators import packing

    rng, n, dtype = np.random.default_rng(5), packing.CHANNELS[channels], np.dtype(kernels.TYPES[precision])
    sources = {}
    for i, (width, rows) in enumerate([(4, 2), (5, 3), (9, 2), (2, 2), (6, 4)]):
        if precision == "f32":
            spread = np.exp2(rng.integers(-40, 20, (rows, width, n)) * (rng.random((rows, width, n)) < 0.5))
            sources[i] = (rng.normal(0.4, 0.6, (rows, width, n)) * spread).astype(np.float32)
            sources[i].reshape(-1)[:4] = [np.nan, np.inf, -np.inf, 0]
        else:
            sources[i] = rng.integers(0, np.iinfo(dtype).max + 1, (rows, width, n)).astype(dtype)
    frame = spark.createDataFrame([(i, s.tobytes(), s.shape[1], s.shape[0]) for i, s in sources.items()], "id long, data binary, width int, rows int")
    rows = packing.strips(frame, packing.NAMES, channels, precision).collect()
    assert len(rows) == len(sources) * len(packing.NAMES)
    for r in rows:
        odd = pixel_info(r.format)[0] == "biplanar" and (sources[r.id].shape[0] % 2 or sources[r.id].shape[1] % 2)
        with np.errstate(all="ignore"):
            want = None if odd else plain_encode.encode(r.format, sources[r.id], channels)
        assert (r.data if r.data is None else bytes(r.data)) == want, (r.format, r.id)
