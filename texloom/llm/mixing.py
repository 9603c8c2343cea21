"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token totals of cells (source, language, topic) are raked to target shares of sources, languages and topics at once: each
step scales the cells of a category so that its expected tokens meet its target, and no probability passes 1 (a cell held
at 1 leaves the rest to the others of its category). The budget is `keep_share` of all tokens, or less where some category
has too few tokens for its share of that. A document is drawn with its cell's probability by a hash of its id and text, so
the draw repeats. Up to `LOCAL_CELLS` cells (checked) are raked on the driver; more stay a table, and each step is a sum by
category and a join. `reached` tells each category's target and what the probabilities give.

Targets are shares by category for any of the three dimensions; categories that a given dimension does not list have
share 0. A dimension without targets gets tempered shares (share ** exponent, normed) of what is there. Null categories are
one more category, named by an empty string.

Results: a null or empty text weighs nothing and is kept (it costs no budget); equal rows are drawn alike; an empty table
gives no rows; extra columns pass; columns of `docs` named like a result are replaced in `mixed` and kept in `drawn_rows`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions.local import local_table

from .common import drop_written, written

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ITERATIONS, TOLERANCE, SLACK, LOCAL_CELLS, BROADCAST_CELLS = 400, 1e-7, 0.95, 100_000, 50_000
RESULT = ("topic", "n_tokens", "probability", "drawn")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: notices of licences, tables, contact lines, long texts, prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains("icense") | t.contains("ights reserved"), "notice").when(t.contains(" | "), "table").when(t.contains("@") | t.contains("://"), "contact").when(F.length(t) > 4000, "long").otherwise("prose")


def goals(cells: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float]) -> dict[str, DataFrame]:
    """By dimension: category, n (its tokens) and share (its target), of the categories that have tokens."""
    out = {}
    for d in DIMENSIONS:
        found = cells.groupBy(F.col(d).alias("category")).agg(F.sum("tokens").alias("n")).filter("n > 0")
        if d in targets:
            wanted = local_table(cells.sparkSession, [(k or "", float(v)) for k, v in targets[d].items()], "category string, weight double")
            found = found.join(F.broadcast(wanted), "category", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        else:
            found = found.withColumn("weight", F.pow("n", F.lit(powers[d])))
        whole = found.agg(F.sum("weight")).first()[0]
        out[d] = found.select("category", "n", (F.col("weight") / F.lit(float(whole)) if whole else F.lit(0.0)).alias("share"))
    return out


def raked(at: list[np.ndarray], tokens: np.ndarray, shares: list[np.ndarray], budget: float) -> np.ndarray:
    """Probabilities of the cells: `at` has each cell's category in each dimension."""
    p = np.full(len(tokens), min(1.0, budget / tokens.sum()))
    for _ in range(ITERATIONS):
        change = 0.0
        for category, share in zip(at, shares, strict=True):
            got = np.bincount(category, tokens * p, len(share))
            factor = np.where(got > 0, budget * share / np.maximum(got, 1e-300), 0.0)
            after = np.minimum(1.0, p * factor[category])
            change = max(change, float(np.abs(after - p).max(initial=0.0)))
            p = after
        if change < TOLERANCE:
            break
    return p


def fitted(cells: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float], keep_share: float, local: int = LOCAL_CELLS) -> DataFrame:
    """source, lang, topic, tokens, probability from a written table of cells (source, lang, topic, tokens)."""
    spark = cells.sparkSession
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if not total:
        return cells.withColumn("probability", F.lit(1.0))
    goal = goals(cells, targets, powers)
    # a category can give no more than it has, and near that the steps close in slowly
    room = min(x for x in (g.filter("share > 0").agg(F.min(F.col("n") / F.col("share"))).first()[0] for g in goal.values()) if x is not None)
    budget = min(keep_share * total, SLACK * room)
    used = cells.filter("tokens > 0")
    if used.count() <= local:
        rows = used.toArrow().to_pylist()
        at, shares = [], []
        for d in DIMENSIONS:
            share = {r.category: r.share for r in goal[d].collect()}
            names = {c: i for i, c in enumerate(sorted(share))}
            at.append(np.array([names[r[d]] for r in rows]))
            shares.append(np.array([share[c] for c in sorted(share)]))
        p = raked(at, np.array([r["tokens"] for r in rows], float), shares, budget)
        out = local_table(spark, [(r["source"], r["lang"], r["topic"], float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, p double")
    else:
        out, last = used.withColumn("p", F.lit(min(1.0, budget / total))), []
        kept = {d: written(g) for d, g in goal.items()}
        for _ in range(ITERATIONS):
            before, made = out, []
            for d in DIMENSIONS:
                got = out.groupBy(F.col(d).alias("category")).agg(F.sum(F.col("tokens") * F.col("p")).alias("got"))
                factor = got.join(kept[d], "category").select(F.col("category").alias(d), F.when(F.col("got") > 0, F.lit(budget) * F.col("share") / F.col("got")).otherwise(0.0).alias("factor"))
                out = written(out.join(factor, d).select(*DIMENSIONS, "tokens", F.least(F.lit(1.0), F.col("p") * F.col("factor")).alias("p")))
                made.append(out)
            moved = out.join(before.select(*DIMENSIONS, F.col("p").alias("was")), list(DIMENSIONS)).agg(F.max(F.abs(F.col("p") - F.col("was")))).first()[0]
            drop_written(*last, *made[:-1])
            last = [out]
            if moved < TOLERANCE:
                break
        drop_written(*kept.values())
        out = out.drop("tokens")
    return cells.join(out, list(DIMENSIONS), "left").select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, F.round("p", 9)).otherwise(1.0).alias("probability"))


def _key(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _facts(docs: DataFrame) -> DataFrame:
    """`docs` as one struct, with what is raked of each row."""
    word = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    return docs.select(F.struct(*docs.columns).alias("row"), _key("source").alias("source"), _key("lang").alias("lang"), topic_of(F.col("text")).alias("topic"), word.alias("n_tokens"), draw.alias("draw"))


def _weighed(docs: DataFrame, targets: dict[str, dict[str, float]] | None, powers: dict[str, float], keep_share: float) -> tuple[DataFrame, DataFrame]:
    """The rows with their probability and whether they are drawn, and the table of cells."""
    facts = _facts(docs)
    cells = written(facts.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    chances = written(fitted(cells, targets or {}, powers, keep_share))
    drop_written(cells)
    joined = chances.drop("tokens")
    if chances.count() <= BROADCAST_CELLS:  # else a sort-merge join, of which skew handling splits a hot source
        joined = F.broadcast(joined)
    out = facts.join(joined, list(DIMENSIONS), "left")
    probability = F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("probability", F.lit(1.0)))
    return out.withColumn("probability", probability).withColumn("drawn", (F.col("draw") < F.col("probability")) | (F.col("n_tokens") == 0)), chances


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] = POWERS, keep_share: float = 0.8) -> DataFrame:
    """`docs` (doc_id, text, lang, source, ...) with topic, n_tokens, probability and drawn."""
    out, _ = _weighed(docs, targets, powers, keep_share)
    return out.select(*(F.col(f"row.{c}") for c in docs.columns if c not in RESULT), *RESULT)


def drawn_rows(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] = POWERS, keep_share: float = 0.8) -> DataFrame:
    """The rows that are drawn, with their own columns."""
    out, _ = _weighed(docs, targets, powers, keep_share)
    return out.filter("drawn").select("row.*")


def reached(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] = POWERS, keep_share: float = 0.8) -> DataFrame:
    """dimension, category, target and reached: each category's target share and its share of the expected tokens."""
    _, cells = _weighed(docs, targets, powers, keep_share)
    goal = goals(cells, targets or {}, powers)
    expected = F.sum(F.col("tokens") * F.col("probability"))
    whole = float(cells.agg(expected).first()[0] or 1)
    out = None
    for d in DIMENSIONS:
        got = cells.groupBy(F.col(d).alias("category")).agg(expected.alias("got"))
        part = goal[d].join(got, "category").select(F.lit(d).alias("dimension"), "category", F.col("share").alias("target"), (F.col("got") / F.lit(whole)).alias("reached"))
        out = part if out is None else out.unionByName(part)
    return out
