"""Byte-level BPE: what its workers hold."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from texloom.llm import bpe, mixing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_dictionary_is_an_array():
    rng = random.Random(5)
    words = ["".join(chr(rng.randrange(50_000)) for _ in range(rng.randrange(1, 7))) for _ in range(100_000)]
    tracemalloc.start()
    known = bpe.Dictionary()
    for at in range(0, len(words), 7_000):
        known.add(words[at : at + 7_000])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 4e6  # as lists of numbers: 20 MB
    for n in (0, 1, 2, 1000):
        text = [rng.randrange(len(words)) for _ in range(n)]
        assert known.text(np.array(text, np.int32)).tolist() == [ord(c) for w in text for c in words[w]]


def test_batches_number_little_text():
    """A batch brings the words of SLICE_BYTES of text at most, unless one text is longer."""
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(2000)] + ["y" * 400_000 + " end"]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    words, back = [], []
    for batch in bpe._number(iter([given]), PATH):
        if batch.column("new")[0].is_valid:
            new, long = batch.column("new")[0].as_py(), iter(batch.column("long")[0].as_py())
            found = [len(w) or len(next(long)) for w in new]
            assert sum(found) <= bpe.SLICE_BYTES or len(found) <= 2
            words += found
        else:
            back += [sum(words[w] for w in doc) for doc in batch.column("words").to_pylist()]
    assert back == [len(t) for t in texts]


def test_encode_gives_the_ids_of_digests(spark):
    """Across slices, long words, empty and null texts, and several dictionaries."""
    rows = [(i, " ".join(f"w{i * j} é" for j in range(60))) for i in range(300)] + [(900, None), (901, ""), (902, "ab" * 60 + " x"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = bpe.encode(docs, PATH).select("doc_id", "n_tokens", F.size("ids").alias("n"), F.sha2(F.array_join("ids", " "), 256).alias("sha")).collect()
    want = bpe.digests(docs, PATH).select("doc_id", "n_tokens", F.col("n_tokens").alias("n"), F.col("ids_sha256").alias("sha")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)


def test_mixing_targets_start_no_python_workers(spark):
    """Targets and probabilities are part of the plan, not lists that Python workers of their own turn into rows."""
    cells = spark.range(6).select(F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit("en").alias("lang"), F.lit("t").alias("topic"), F.lit(5).cast("long").alias("tokens"))
    goal = mixing.goals(cells, {"source": {"s0": 0.5, "s1": 0.5}}, {d: 1.0 for d in mixing.DIMENSIONS})["source"]
    assert "ExistingRDD" not in (plan := goal._jdf.queryExecution().executedPlan().toString()) and "LogicalRDD" not in plan, plan
    assert {r.category: r.share for r in goal.collect()} == {"s0": 0.5, "s1": 0.5}
