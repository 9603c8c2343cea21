"""Registered queries of mip chains with filters, with DuckDB SQL that derives the weights by itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from texloom.operators import mips
from texloom.plans import fixtures as X
from texloom.plans.texture_queries import query

WIDTH, HEIGHT = 97, 41


def _surfaces(spark, sf_dir):
    """The events as surfaces of 97 x 41 pixels; what the last one lacks is transparent black."""
    px = X.pixels(spark, sf_dir, WIDTH).withColumn("surface", F.floor(F.col("y") / HEIGHT)).withColumn("y", F.col("y") % HEIGHT)
    grid = px.select("surface").distinct().select("surface", F.explode(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))).alias("i"))
    grid = grid.select("surface", (F.col("i") % WIDTH).cast("long").alias("x"), F.floor(F.col("i") / WIDTH).alias("y"))
    filled = grid.join(px, ["surface", "x", "y"], "left").select("surface", "x", "y", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("r", "g", "a")))
    return filled.withColumns({"width": F.lit(WIDTH).cast("long"), "height": F.lit(HEIGHT).cast("long")})


_GRID_SQL = """ev AS (SELECT event_id // 97 // 41 AS surface, event_id % 97 AS x, event_id // 97 % 41 AS y, CAST(floor(least(value / 500, 1.0) * 255 + 0.5) AS DOUBLE) AS r, CAST((event_id * 37) % 256 AS DOUBLE) AS g, CASE WHEN event_type = 'error' THEN 0.0 ELSE 255.0 END::DOUBLE AS a FROM events),
gr AS (SELECT s.surface, i % 97 AS x, i // 97 AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(a, 0) AS a FROM (SELECT DISTINCT surface FROM ev) s CROSS JOIN (SELECT unnest(range(97 * 41)) AS i) LEFT JOIN ev ON ev.surface = s.surface AND ev.x = i % 97 AND ev.y = i // 97)"""
_KERNELS = {
    "box": (0.5, "CASE WHEN d > -0.5 AND d <= 0.5 THEN 1.0::DOUBLE ELSE 0 END"), "triangle": (1, "greatest(0, 1 - abs(d))"),
    "mitchell": (2, "CASE WHEN abs(d) < 1 THEN (21 * pow(abs(d), 3) - 36 * d * d + 16) / 18 WHEN abs(d) < 2 THEN (-7 * pow(abs(d), 3) + 36 * d * d - 60 * abs(d) + 32) / 18 ELSE 0 END"),
    "lanczos3": (3, "CASE WHEN d = 0 THEN 1 WHEN abs(d) < 3 THEN 3 * sin(pi() * d) * sin(pi() * d / 3) / pow(pi() * d, 2) ELSE 0 END"),
}


def _weights_sql(name: str, filter: str, src: int, dst: int) -> str:
    if filter == "nearest":
        return f"{name} AS (SELECT t, least({src - 1}, CAST(floor((t + 0.5) * {src} / {dst}) AS BIGINT)) AS s, 1.0::DOUBLE AS w FROM range({dst}) r(t))"
    support, value = _KERNELS[filter]
    scale = max(src / dst, 1.0)
    return f"""{name} AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM (SELECT t, s, {value} AS w FROM (SELECT t, s, (s + 0.5 - (t + 0.5) * {src / dst!r}::DOUBLE) / {scale!r}::DOUBLE AS d FROM range({dst}) a(t), range({src}) b(s)) WHERE abs(d) <= {support}) WHERE w <> 0)"""


def _chain_sql(filter: str, levels: int, straight: bool) -> tuple[str, list[str]]:
    """Every level from the one before it: weights of both directions, then one sum over all pairs."""
    parts, w, h, before = [_GRID_SQL], WIDTH, HEIGHT, "gr"
    whole = lambda v: f"CAST(least(255, greatest(0, floor(round({v}, 9) + 0.5))) AS DOUBLE)"
    for k in range(1, levels):
        w2, h2 = max(w // 2, 1), max(h // 2, 1)
        parts += [_weights_sql(f"wx{k}", filter, w, w2), _weights_sql(f"wy{k}", filter, h, h2)]
        colour = (lambda c: f"CASE WHEN sum(a * u.w * v.w) > 0.000255 THEN sum({c} * a * u.w * v.w) / sum(a * u.w * v.w) ELSE 0 END") if straight else (lambda c: f"sum({c} * u.w * v.w)")
        parts.append(f"m{k} AS (SELECT surface, u.t AS x, v.t AS y, {whole(colour('r'))} AS r, {whole(colour('g'))} AS g, {whole('sum(a * u.w * v.w)')} AS a FROM {before} p JOIN wx{k} u ON u.s = p.x JOIN wy{k} v ON v.s = p.y GROUP BY surface, u.t, v.t)")
        w, h, before = w2, h2, f"m{k}"
    shown = [f"SELECT surface, CAST({k} AS INTEGER) AS mip_level, x, y, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(a AS BIGINT) AS a FROM {'m' + str(k) if k else 'gr'}" for k in range(levels)]
    return " UNION ALL ".join(shown), parts


def _kept(spark):
    """Write each level before the next is made from it, in the session's shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = (shared or tempfile.mkdtemp(prefix="texloom-")).rstrip("/")

    def cut(frame):
        path = f"{base}/mips-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return spark.read.parquet(path)

    return cut


def _chain(filter: str, levels: int, straight: bool = False):
    def run(spark, sf_dir):
        out = mips.chain(_surfaces(spark, sf_dir), levels, filter, ["surface"], ["r", "g", "a"], straight, _kept(spark))
        return out.select("surface", "mip_level", "x", "y", "r", "g", "a")

    return run


for _filter in mips.SUPPORT:
    _run = _chain(_filter, 7)
    _run.__name__, _run.__doc__ = f"q_mip_chain_{_filter}", f"All seven levels of surfaces of 97 x 41 pixels, {_filter} filter."
    _sql, _parts = _chain_sql(_filter, 7, False)
    query(_sql, *_parts)(_run)
_run = _chain("triangle", 4, True)
_run.__name__, _run.__doc__ = "q_mip_chain_alpha", "Four levels with colours weighted by straight alpha."
query(*(lambda sql, parts: (sql, *parts))(*_chain_sql("triangle", 4, True)))(_run)
