"""The file source and sink: bytes read back, options, bad files, incomplete writes, rectangles, strips."""

import os
import re
import struct

import pytest
from pyspark.sql import functions as F

from tests import plain_decode
from texloom.operators import decode, layout
from texloom.sources import container, files

# Fixed values of the container's public description.
HEADER = {"size": 124, "flags": 0x1007, "caps": 0x1000, "pf_size": 32}
DX10_TAG = int.from_bytes(b"DX10", "little")


def header(width, height, mips=1, four_cc=None, dxgi=None, array=1, **more):
    words = dict.fromkeys(container.WORDS, 0) | HEADER | {"width": width, "height": height, "mipmap_count": mips}
    words |= {"flags": HEADER["flags"] | (0x20000 if mips > 1 else 0), "pf_flags": 4, "four_cc": DX10_TAG if dxgi else int.from_bytes(four_cc, "little")} | more
    extension = [dxgi, 3, 0, array, 0] if dxgi else []
    return b"DDS " + struct.pack(f"<{31 + len(extension)}I", *words.values(), *extension)


def put(folder, name, data):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


@pytest.fixture()
def folder(tmp_path):
    noise = bytes(i * 7 % 251 for i in range(4000))
    put(tmp_path, "a.dds", header(9, 5, 3, dxgi=61) + noise[: 45 + 8 + 2])
    put(tmp_path, "deep/b.dds", header(13, 10, four_cc=b"DXT1") + noise[: 4 * 3 * 8])
    put(tmp_path, "deep/c.dds", header(8, 8, dxgi=103) + noise[: 64 + 32])
    put(tmp_path, "bad.dds", b"nothing of the kind" * 20)
    put(tmp_path, "short.dds", b"DDS ")
    put(tmp_path, "other.txt", b"x")
    put(tmp_path, "_hidden/d.dds", header(1, 1, dxgi=61) + b"z")
    return str(tmp_path)


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_opened_headers(spark, folder):
    rows = {name_of(r.path): r for r in files.opened(spark, folder, suffix=".dds").collect()}
    assert sorted(rows) == ["a.dds", "b.dds", "bad.dds", "c.dds", "short.dds"]
    assert [(rows[f].format, rows[f].data_len, rows[f].data_start) for f in ("a.dds", "b.dds", "c.dds")] == [("R8_UNORM", 55, 148), ("BC1_UNORM", 96, 128), ("NV12", 96, 148)]
    assert all(rows[f].length == rows[f].data_start + rows[f].data_len for f in ("a.dds", "b.dds", "c.dds"))
    assert (rows["bad.dds"].error.code, rows["short.dds"].error.code) == ("InvalidMagicBytes", "Io")
    assert files.opened(spark, f"{folder}/a.dds").count() == 1


def test_only_the_heads_are_read(spark, tmp_path):
    put(tmp_path, "big.dds", header(4096, 4096, dxgi=61) + bytes(4096 * 4096))
    files.register(spark)
    row = spark.read.format("texture").load(str(tmp_path)).first()
    assert len(row.head) == files.HEAD_BYTES and row.length == 148 + (1 << 24)


def test_options(spark, tmp_path):
    put(tmp_path, "m.dds", header(9, 5, dxgi=61)[4:] + bytes(45))
    put(tmp_path, "n.dds", header(9, 5, 2, dxgi=61)[4:] + bytes(45))
    plain = files.opened(spark, str(tmp_path), container.ParseOptions(skip_magic=True)).orderBy("path").collect()
    assert [(r.data_start, r.mipmap_count, r.data_len) for r in plain] == [(144, 1, 45), (144, 2, 53)]
    lax = files.opened(spark, str(tmp_path), container.ParseOptions(skip_magic=True, permissive=True)).orderBy("path").collect()
    assert [(r.mipmap_count, r.data_len) for r in lax] == [(1, 45), (1, 45)]
    other = files.opened(spark, str(tmp_path), container.ParseOptions(skip_magic=True), format="BC3_UNORM_NORMAL").first()
    assert (other.format, other.data_len) == ("BC3_UNORM_NORMAL", 3 * 2 * 16)
    with pytest.raises(ValueError):
        files.opened(spark, str(tmp_path), format="NO_SUCH")


def test_surfaces_and_their_bytes(spark, folder):
    rows = files.with_bytes(files.surfaces(files.opened(spark, folder, suffix=".dds"))).collect()
    for r in rows:
        whole = open(r.path, "rb").read()
        assert bytes(r.data) == whole[r.start : r.start + r.size]
    assert sorted((name_of(r.path), r.mip_level, r.width, r.height, r.elapsed, r.size) for r in rows) == [("a.dds", 0, 9, 5, 0, 45), ("a.dds", 1, 4, 2, 45, 8), ("a.dds", 2, 2, 1, 53, 2), ("b.dds", 0, 13, 10, 0, 96), ("c.dds", 0, 8, 8, 0, 96)]


def test_a_file_too_short_gives_null(spark, tmp_path):
    put(tmp_path, "s.dds", header(9, 5, 2, dxgi=61) + bytes(50))
    rows = files.with_bytes(files.surfaces(files.opened(spark, str(tmp_path)))).orderBy("mip_level").collect()
    assert [r.data is None for r in rows] == [False, True]


# Rectangles on 13 x 10 pixels of 4 x 4 blocks: whole, inside, one pixel, along the edge.
RECTANGLES = [(0, 0, 13, 10), (2, 3, 7, 5), (12, 9, 1, 1), (0, 8, 13, 2), (5, 0, 1, 10)]


def test_regions_equal_crops(spark, folder):
    """Only the rectangles' blocks are read, only their pixels come out, equal to those of the whole surface."""
    rects = spark.createDataFrame([(i, *r) for i, r in enumerate(RECTANGLES)], "no int, rx long, ry long, rw long, rh long")
    surface = files.surfaces(files.opened(spark, folder, suffix="b.dds")).crossJoin(rects)
    ranges = files.with_bytes(files.region(surface, F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh"))).cache()
    full = plain_decode.decode("BC1_UNORM", open(f"{folder}/deep/b.dds", "rb").read()[128:], 13, 10)
    got = decode.region_pixels(ranges, "BC1_UNORM").select("no", "x", "y", "r", "g", "b", "a").collect()
    want = [(no, i, j, *map(int, full[j, i])) for no, (x, y, w, h) in enumerate(RECTANGLES) for j in range(y, y + h) for i in range(x, x + w)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    sizes = {r.no: r.n for r in ranges.groupBy("no").agg(F.sum("size").alias("n")).collect()}
    for no, (x, y, w, h) in enumerate(RECTANGLES):
        assert sizes[no] == 8 * (-(-(x + w) // 4) - x // 4) * (-(-(y + h) // 4) - y // 4)


def test_odd_regions(spark, folder):
    surface = files.surfaces(files.opened(spark, folder, suffix="b.dds"))
    rects = [(10, 0, 4, 1), (0, 9, 1, 2), (-1, 0, 1, 1), (14, 0, 0, 0), (3, 3, 0, 4), (13, 10, 0, 0)]
    asked = surface.crossJoin(spark.createDataFrame([(i, *r) for i, r in enumerate(rects)], "no int, rx long, ry long, rw long, rh long"))
    rows = files.with_bytes(files.region(asked, F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh"))).collect()
    assert sorted((r.no, r.error, r.data) for r in rows) == [(i, "RectOutOfBounds", None) for i in range(4)]
    planes = files.surfaces(files.opened(spark, folder, suffix="c.dds"))
    assert [(r.size, r.lines) for r in files.region(planes, F.lit(1), F.lit(1), F.lit(2), F.lit(2)).collect()] == [(96, 8)]


def test_a_filter_reads_fewer_bytes(spark, folder):
    """A filter on the level reaches the rows before the read: only what passes is opened."""
    rows = files.with_bytes(files.surfaces(files.opened(spark, folder, suffix=".dds")).filter("mip_level = 2"))
    assert [len(r.data) for r in rows.collect()] == [2]


def test_strips(spark, folder):
    rows = files.with_bytes(files.strips(files.surfaces(files.opened(spark, folder, suffix=".dds")), pixels=60)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.first_y):
        by.setdefault((name_of(r.path), r.mip_level), []).append(r)
    for (name, _), parts in by.items():
        whole = open(parts[0].path, "rb").read()
        assert b"".join(bytes(r.data) for r in parts) == whole[parts[0].start : parts[0].start + sum(r.size for r in parts)]
        assert sum(r.lines for r in parts) == parts[0].height
    assert [(r.first_y, r.lines) for r in by["b.dds", 0]] == [(0, 4), (4, 4), (8, 2)]
    assert len(by["c.dds", 0]) == 1


# -- sink --------------------------------------------------------------------------------------------------------------


def planned(spark, names, mips=2):
    none, long = F.lit(None).cast("long"), lambda v: F.lit(v).cast("long")
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "file_id long, file string").select(
        "file_id", "file", F.lit("dx10").alias("version"), long(6).alias("width"), long(4).alias("height"), none.alias("depth"), long(mips).alias("mipmap_count"),
        *(none.alias(c) for c in ("four_cc", "pf_flags", "bits", "r_mask", "g_mask", "b_mask", "a_mask", "caps2")), F.lit(61).alias("dxgi"), F.lit(3).alias("resource_dim"), long(0).alias("misc"), long(1).alias("array_size"), F.lit(0).alias("alpha_mode"),
    )
    return layout.with_layout(container.with_format(rows))


DATA = "file string, array_index long, mip_level int, depth_slice long, data binary"
GOOD = [(0, b"a" * 24), (1, b"b" * 6)]


def pieces(spark, headers, names, levels=GOOD):
    data = spark.createDataFrame([(n, 0, level, 0, d) for n in names for level, d in levels], DATA)
    return files.checked(headers, data)


def left(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_written_files(spark, tmp_path):
    names = ["one.dds", "sub/two.dds"]
    files.write(pieces(spark, planned(spark, names), names), str(tmp_path))
    assert left(tmp_path) == names and sorted(os.listdir(tmp_path)) == ["one.dds", "sub"]
    want = header(6, 4, 2, dxgi=61)
    for n in names:
        got = open(tmp_path / n, "rb").read()
        assert got[148:] == b"a" * 24 + b"b" * 6 and len(got) == 178
        words, own = struct.unpack("<36I", got[4:148]), struct.unpack("<36I", want[4:])
        at = {w: i for i, w in enumerate([*container.WORDS, *container.DX10_WORDS])}
        assert all(words[at[w]] == own[at[w]] for w in ("size", "width", "height", "mipmap_count", "pf_size", "four_cc", "dxgi", "resource_dim", "array_size"))
        assert words[at["flags"]] == 0x1 | 0x2 | 0x4 | 0x1000 | 0x20000 | 0x8 and words[at["pitch"]] == 6
    files.write(pieces(spark, planned(spark, ["new.dds"]), ["new.dds"]), str(tmp_path), overwrite=True)
    assert left(tmp_path) == ["new.dds"]
    files.write(pieces(spark, planned(spark, ["more.dds"]), ["more.dds"]), str(tmp_path))
    assert left(tmp_path) == ["more.dds", "new.dds"]


@pytest.mark.parametrize(
    ("parts", "error"),
    [([(0, 24)], "MissingSurfaces"), ([(24, 6)], "MissingSurfaces"), ([(0, 24), (24, 6), (30, 1)], "TooManySurfaces"), ([(0, 25), (24, 6)], "UnexpectedSurfaceSize")],
)
def test_incomplete_files_are_refused(spark, tmp_path, parts, error):
    """Nothing is left of the job, the good file of the same job included."""
    rows = [("good.dds", 5, 0, b"abcde"), *(("bad.dds", 30, start, b"x" * n) for start, n in parts)]
    with pytest.raises(Exception, match=error):
        files.write(spark.createDataFrame(rows, "file string, file_size long, start long, data binary"), str(tmp_path / "out"))
    assert left(tmp_path / "out") == []


def test_surfaces_that_no_layout_wants(spark, tmp_path):
    headers = planned(spark, ["bad.dds"])
    for levels, error in (([*GOOD, (2, b"c")], "TooManySurfaces"), (GOOD[1:], "MissingSurfaces"), ([(0, b"a" * 25), GOOD[1]], "UnexpectedSurfaceSize")):
        with pytest.raises(Exception, match=error):
            files.write(pieces(spark, headers, ["bad.dds"], levels), str(tmp_path / "out"))


def test_repair_keeps_every_row(spark):
    """Rows of one file_id are repaired each for itself; a cube's six faces and a full chain are found by the length."""
    headers = planned(spark, ["a", "b", "c", "d"], mips=1).select("*", F.lit(0).alias("no"))
    rows = headers.withColumns({"file_id": F.lit(7).cast("long"), "no": F.col("file_id")})
    rows = rows.withColumns({"array_size": F.when(F.col("no") == 0, 6).when(F.col("no") == 1, 0).otherwise(1).cast("long"), "misc": F.when(F.col("no") == 0, 4).otherwise(0).cast("long"), "width": F.when(F.col("no") == 0, 4).otherwise(F.col("width"))})
    length = F.when(F.col("no") == 0, 6 * 16).when(F.col("no") == 1, 24).when(F.col("no") == 2, 24 + 6 + 1).otherwise(1000) + 148
    got = container.repair(rows.drop("layout_kind", "elements", "faces", "layout_height", "element_len", "data_len", "layout_error"), length).collect()
    assert sorted((r.no, r.array_size, r.mipmap_count) for r in got) == [(0, 1, 1), (1, 1, 1), (2, 1, 3), (3, 1, 1)]


def test_a_task_sends_no_list_of_its_files(tmp_path):
    """What a write task sends to the driver does not grow with its files, and all of them are moved, odd names too."""
    import pickle

    import pyarrow as pa

    sent = []
    for n in (1, 300):
        names = sorted([*(f"d{i % 3}/{i}.dds" for i in range(n - 1)), "a line\nand ü.dds"])
        batch = pa.RecordBatch.from_pydict({"file": names, "file_size": [2] * n, "start": [0] * n, "data": [b"ab"] * n})
        path = str(tmp_path / str(n))
        sink = files.PieceWriter({"path": path}, False)
        message = sink.write(iter([batch]))
        sent.append(len(pickle.dumps(message)) - len(path))
        sink.commit([message, None])
        found = sorted(os.path.relpath(os.path.join(at, f), path) for at, _, some in os.walk(path) for f in some)
        assert found == names
    assert sent[0] == pytest.approx(sent[1], abs=8)


@pytest.mark.parametrize("set_before", [None, "123456789"])
def test_sink_takes_small_batches(spark, tmp_path, monkeypatch, set_before):
    """The sink's batches are bounded by bytes: 1,000 pieces of 50,000 bytes do not come at once."""

    class Bounded(files.PieceWriter):
        def write(self, batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 5 << 20, f"a batch of {batch.nbytes} bytes"
                    yield batch

            return super().write(small())

    class Source(files.TextureSource):
        def writer(self, schema, overwrite):
            return Bounded(self.options, overwrite)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(files, "register", lambda session: session.dataSource.register(Source))
    spark.conf.unset(key) if set_before is None else spark.conf.set(key, set_before)
    try:
        size = F.lit(50_000).cast("long")
        pieces = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("f"), F.floor(F.col("id") / 500)).alias("file"), (size * 500).alias("file_size"), (F.col("id") % 500 * size).alias("start"), F.expr("cast(repeat('x', 50000) as binary)").alias("data"))
        files.write(pieces, str(tmp_path / "out"))
        assert [p.stat().st_size for p in sorted((tmp_path / "out").iterdir())] == [25_000_000] * 2
        assert spark.conf.get(key, None) == set_before
    finally:
        spark.conf.unset(key)
        monkeypatch.undo()
        files.register(spark)


def plain_names(path, suffix=""):
    """All files under a folder, none that is hidden or in a hidden folder."""
    found = [os.path.join(at, f) for at, _, some in os.walk(path) for f in some]
    return sorted(f for f in found if f.endswith(suffix) and not any(part[0] in "._" for part in os.path.relpath(f, path).split(os.sep)))


TREES = {
    "flat": [f"{i}.dds" for i in range(30)],
    "one below the other": ["a/b/x.dds", "a/b/c/y.dds", "a/b/c/z.txt", "a/v.dds"],
    "some": ["r.dds", *(f"d{i % 3}/{i}.dds" for i in range(40)), "d1/deep/er/s.dds", "d1/.t/u.dds", "_v/w.dds", "d2/_x.dds"],
    "one, hidden beside": ["d/1.dds", "d/2.dds", "_e/3.dds", ".f"],
    "none": [],
}


@pytest.mark.parametrize("tree", TREES)
@pytest.mark.parametrize("suffix", ["", ".dds"])
def test_all_files_are_listed(spark, tmp_path, tree, suffix):
    """Each file once, from folders of any form, by `opened`'s listing in tasks and by the source."""
    for name in TREES[tree]:
        put(tmp_path, name, name.encode() * 20)
    want = [(f, os.path.getsize(f), open(f, "rb").read(files.HEAD_BYTES)) for f in plain_names(tmp_path, suffix)]
    files.register(spark)
    source = spark.read.format("texture").option("path", str(tmp_path)).option("suffix", suffix).option("filesPerTask", 7).load()
    assert [r.path for r in files.heads(spark, str(tmp_path), suffix).collect()] == [w[0] for w in want]
    for found in (files.heads(spark, f"file://{tmp_path}/", suffix), source):
        assert sorted((r.path, r.length, bytes(r.head)) for r in found.collect()) == want


def test_no_list_of_files_reaches_the_driver(spark, tmp_path):
    """What the source sends to plan a read does not grow with the files' names, and `opened` plans none."""
    import pickle

    for i in range(3000):
        put(tmp_path, f"d{i % 3}/{'n' * 100}{i}.dds", b"x")
    shares = files.HeadReader({"path": str(tmp_path), "filespertask": "50"}).partitions()
    assert sum(len(pickle.dumps(s)) for s in shares) < 10_000
    assert len(shares) == files.READ_TASKS
    assert "BatchScan" not in files.opened(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_tables_of_surfaces_are_not_broadcast(spark, monkeypatch):
    """Headers of many files are small as Parquet: whatever their size is taken for, no join gathers a row for each on the driver."""
    from texloom.plans import file_queries

    written = []
    monkeypatch.setattr(files, "write", lambda pieces, path: written.append(pieces))
    file_queries._stored(spark, "/root/testdata/sf0.001")
    joins = [line for line in written[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    by_file = [line for line in joins if re.search(r"\bfile(_id)?#", line)]
    assert by_file and not [line for line in by_file if "Broadcast" in line]
    # the tables of formats alone are broadcast; the texts are joined once
    assert len(by_file) == 1


def test_a_surface_of_no_file_is_refused(spark, tmp_path):
    headers = planned(spark, ["good.dds"])
    with pytest.raises(Exception, match="TooManySurfaces: other.dds"):
        files.write(pieces(spark, headers, ["good.dds", "other.dds"]), str(tmp_path / "out"))
    assert left(tmp_path / "out") == []
