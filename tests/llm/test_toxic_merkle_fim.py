"""Toxic segments, the Merkle manifest and fill-in-middle against brute force, and the mended cases of earlier operators."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import docs, empty, rows, same  # noqa: F401

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- toxic segments ----------------------------------------------------------------------------------------------------


def all_maximal(scores):
    """By the definition: the best contiguous segment, then the same on either side of it."""
    if not len(scores):
        return []
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j + 1)
    if best is None:
        return []
    _, a, b = best
    return [*all_maximal(scores[:a]), best, *((s, i + b, j + b) for s, i, j in all_maximal(scores[b:]))]


def test_segments_are_all_maximal():
    from texloom.llm import toxicity

    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3.1, -1.7, -0.4, 0.6, 1.3, 2.9]) + rng.random() / 100 for _ in range(rng.randrange(1, 30))]
        want = all_maximal(scores)
        got = sorted(toxicity.segments(np.array(scores)), key=lambda x: x[1])
        if not want:
            assert got == [(max(scores), scores.index(max(scores)), scores.index(max(scores)) + 1)]
        else:
            assert [x[1:] for x in got] == [x[1:] for x in want]
            assert np.allclose([x[0] for x in got], [x[0] for x in want])
    assert toxicity.segments(np.zeros(0)) == []


def test_word_scores_by_brute_force(spark, docs):
    """Counts and log-odds of every word of every text by plain loops, with a text's own part left out."""
    from texloom.llm import toxicity
    from texloom.llm.common import written

    source = [(i, f"{'stupid troll' if i % 3 == 0 else 'kind reader'} number {i % 7}, Écoute: word{i % 4} stupid-ish x x") for i in range(40)]
    marked = [(i, t, int(i % 3 == 0)) for i, t in source]
    train = spark.createDataFrame(marked, "doc_id long, text string, toxic int")
    model = toxicity.Model(written(toxicity.text_counts(train)))
    split = lambda t: re.sub(r"[^0-9a-zé]", " ", t.lower()).split()
    keys = lambda w: [w.encode()[:n] if len(w.encode()) > n else None for n in toxicity.PREFIXES] + [w.encode()]
    base = 14.5 / 40
    for i, text, label in marked[:12]:
        words = toxicity.Words.of([text.encode()])
        for own in (None, label):
            got = toxicity.word_scores(words, model.shared.value, base, None if own is None else np.array([own]))
            want, seen = [], {}
            for w in split(text):
                share = base
                for kind, key in enumerate(keys(w)):
                    if key is None:
                        continue
                    n = [0, 0]
                    for j, other, y in marked:
                        if not (own is not None and j == i):
                            n[y] += any(keys(x)[kind] == key for x in split(other))
                    share = (n[1] + toxicity.PRIOR * share) / (n[0] + n[1] + toxicity.PRIOR)
                odds = math.log(share / (1 - share)) - math.log(base / (1 - base))
                seen[w] = seen.get(w, 0) + 1
                want.append((odds / seen[w] if odds > 0 else odds) - toxicity.DRIFT)
            assert np.allclose(got, want)


def toxic_corpus(spark, n=1500, seed=2):
    """Clean prose of an alphabet, a third of it with a passage of rude stems among which most forms occur once."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels, spans = [], [], {}
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        toxic = i % 3 == 0
        if toxic:
            at = rng.randrange(len(words) + 1)
            rude = ["zzrude" + "".join(rng.choice("stuv") for _ in range(4)) if rng.random() < 0.5 else rng.choice(["qqfool", "qqclod", "Qqoaf,"]) for _ in range(6)]
            words[at:at] = rude
            spans[i] = (len(" ".join(words[:at]).encode()) + (at > 0), " ".join(rude).rstrip(","))
        docs.append((i, " ".join(words)))
        if i % 10 < 7:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spans


def test_toxic_rows_and_passages(spark):
    from texloom.llm import toxicity

    docs, labels, spans = toxic_corpus(spark)
    found = toxicity.judge(docs, labels).collect()
    assert {r.doc_id for r in found if r.held_out} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = [r.doc_id for r in found if r.predicted != (r.doc_id % 3 == 0)]
    assert len(wrong) <= 8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    law, model = toxicity.learned(docs.filter(~toxicity.held_out()), labels)
    hit = 0
    for r in toxicity.passages(docs, law, model).collect():
        for p in r.passages:
            assert p.z >= toxicity.SIGNIFICANT
        hit += r.doc_id in spans and any(p["first"] <= spans[r.doc_id][0] and spans[r.doc_id][1] in p.passage for p in r.passages)
    assert hit >= 0.9 * len(spans)


def test_toxicity_looks_at_the_text_only(spark):
    """Labels of held-out rows and the other columns change nothing."""
    from texloom.llm import toxicity

    docs, labels, _ = toxic_corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    more = docs.withColumns({"source": F.lit("s"), "lang": F.lit("l"), "toxic": F.lit(1), "score": F.lit("x")})
    same(toxicity.judge(docs, labels).collect(), toxicity.judge(more, turned).collect())


def test_both_ways_of_scoring_agree_with_copies(spark, monkeypatch):
    """Entries joined slice by slice, with one row copied so often that its slice needs several tasks."""
    from texloom.llm import lookup, toxicity

    docs, labels, _ = toxic_corpus(spark, 300)
    docs = docs.union(docs.filter("doc_id = 3").crossJoin(spark.range(600)).select("doc_id", "text"))
    want = toxicity.judge(docs, labels).collect()
    monkeypatch.setattr(lookup, "SLICE_BYTES", 20_000)
    same(toxicity.judge(docs, labels, bound=0).collect(), want)


def test_toxicity_of_odd_tables(spark, docs, empty):
    from texloom.llm import toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.judge(docs, labels).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.doc_id in (9001, 9002, 9005):
            assert (r.score, r.predicted, r.n_passages, r.statistic) == (0.0, 0, 0, None)
    assert toxicity.judge(empty, labels).count() == 0
    none = toxicity.judge(docs, labels.filter("false")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)


# -- Merkle manifest ---------------------------------------------------------------------------------------------------


def tree(nodes):
    """All levels, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        run = i // 16 * 16
        yield level[run:i], level[i + 1 : run + 16]
        i //= 16


def manifest_rows(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: sha("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")) + field(t))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, own, r) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            path = [*steps(trees[s], i), *steps(top, at)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now = leaf(r, r["text"].translate(lower)) if hit and r["text"] is not None else own
            for lo, hi in path:
                now = sha("".join(lo) + now + "".join(hi))
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], sha("".join("".join(lo) + "".join(hi) for lo, hi in path)), now, now == top[-1][0]))
    return out


def test_manifest(spark, docs, empty):
    from texloom.llm import merkle

    same([tuple(r) for r in merkle.verified(docs).collect()], manifest_rows(docs.collect()))
    assert merkle.verified(empty).count() == 0
    one = docs.filter("doc_id = 9004")
    same([tuple(r) for r in merkle.verified(one).collect()], manifest_rows(one.collect()))
    assert merkle.verified(one).first().proof_sha256 == sha("")


def test_manifest_of_a_hot_source_and_many_sources(spark):
    """Trees of three levels, sources of one row, a null one, repeated rows; the order of input plays no part."""
    from texloom.llm import merkle

    wide = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("s"), F.col("id") % 300)).alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(3).alias("n_chars"), F.concat(F.lit("Text "), F.col("id")).alias("text"))
    wide = wide.union(wide.filter("doc_id < 20")).union(wide.filter("doc_id = 4").withColumn("text", F.lit(None).cast("string")))
    want = manifest_rows(wide.collect())
    same([tuple(r) for r in merkle.verified(wide.repartition(7)).collect()], want)
    plan = [tuple(r) for r in merkle.manifest(wide).select("doc_id", F.size("path")).collect()]
    assert max(n for _, n in plan) == 5  # three levels in the hot source, two over 270 sources or so


# -- fill-in-middle ----------------------------------------------------------------------------------------------------


def cut_by_hand(doc_id, text):
    units, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in SPACE:
            j += 1
        while j < len(text) and text[j] not in SPACE:
            j += 1
        units.append(text[i:j])
        i = j
    h = sha(f"42:{doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, docs, empty):
    from texloom.llm import fim

    odd = [(i, t) for i in range(40) for t in ("a <P> b", "<S", "< S> x <M y", "  lead and tail \n ", "　wide space", "<<S<P", "🙂 🙂\t🙂", "\x1c\x85 no space of ours", "\n" * 50)]
    more = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, score string"))
    rows = [(r.doc_id, r.text) for r in more.collect()]
    made = [(i, t or "", cut_by_hand("" if i is None else i, t or "")) for i, t in rows]
    same([tuple(r) for r in fim.digests(more).collect()], [(i, *c[:4], sha(c[4]), sha(t)) for i, t, c in made])
    same([tuple(r) for r in fim.fill_in_middle(more).collect()], [(i, *c) for i, t, c in made])
    assert {c[1] for _, _, c in made} == {"plain", "psm", "spm"}
    assert fim.digests(empty).count() == 0


def test_every_cut_is_restored():
    from texloom.llm import fim

    rng = random.Random(9)
    for i in range(3000):
        text = "".join(rng.choice(["<", ">", "P", "S", "M", " ", "\n", "é", "ab"]) for _ in range(rng.randrange(12)))
        made = fim.transform(str(i), text, fim.Rates(transformed=100, spm=50))
        assert fim.restore(made.output, made.form) == text


# -- mended cases ------------------------------------------------------------------------------------------------------


def test_repeated_query_rows(spark):
    """Equal query rows are one query, other vectors of the id a query of its own; empty vectors count as zeros."""
    from texloom.llm import topk

    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.8, 0.1]), (3, [0.7, 0.0]), (4, [0.6, 0.0]), (5, [0.5, 0.0]), (6, [0.4, 0.0]), (100, [0.0, 1.0]), (100, [-1.0, 0.0]), (7, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).collect()
    want = []
    for q, v in [(50, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [-1.0, 0.0])]:
        score = lambda w, v=v: sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, np.float32(w).astype(float), strict=False))
        best = sorted(((-score(w), i) for i, w in rows if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    same([tuple(r) for r in got], want)


def test_kept_rows_with_clashing_names(spark):
    from texloom.llm import minhash

    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text, "a", 7, 1), (2, text, "b", 8, 2), (3, "other words", "c", 9, 3), (None, "null id", "d", 1, 4)], "doc_id long, text string, _id string, _h long, h int")
    got = minhash.kept_rows(rows)
    assert got.columns == rows.columns
    same([tuple(r) for r in got.collect()], [tuple(r) for r in rows.collect() if r.doc_id != 2])
