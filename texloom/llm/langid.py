"""Language identification by interpolated Kneser-Ney character models.

One model of order `ORDER` for each language: n-gram counts over all training rows, discounts from the counts of counts,
continuation counts below the top order, interpolation down to a uniform distribution. All of that is joins and sums in
Spark over every n-gram: nothing is pruned, and the model grows with what was learned from. It is a table of entries, an
n-gram's log-probability or a context's back-off weight in one language, which scoring reads as sorted hash arrays of
64-bit keys (16 bits a character; see lookup.py for what happens when they get too many to be sent to every task). The
language with the lowest cross-entropy (bits a character) wins.

Rejection is calibrated for each language on all of its distinct texts. The texts are dealt to `FOLDS` by their hash, so that
copies stay together, and each is scored by the models of the other folds' texts, which did not count it; the models that
predict count every text. For each range of lengths, the limit is the cross-entropy that a share of `QUANTILE` stays within,
in steps of 1 / `STEPS` bits, plus `MARGIN` bits; the highest text of a language never sets it, where there are `SPARSE`.
Short ranges are filled with the beginnings of the texts; where a language has under `FEW` of them it is no stricter than
all languages together, and where these have under `SPARSE` no stricter than the next shorter range. Without any such text
the limit is that of a uniform guess over the alphabet.

Text is lower-cased; runs of characters that are not letters become one space. Results: a text that is null or has no
letter is `und` with score 0, and rejected; ties go to the first language by name; repeated rows and null ids each give a
row; with nothing to learn from, every row is `und`; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.functions.local import local_table

from .common import distinct, drop_written, released, slices, written
from .lookup import BROADCAST_ENTRIES, Asked, Entries, Model, Tally

ORDER, FOLDS = 4, 8
QUANTILE, STEPS, MARGIN, FEW, SPARSE, RANGES = 0.998, 1000, 0.1, 200, 20, 33
CELLS = 1 << 22
UNDETERMINED = "und"
_SPACE = 32
_letters: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """16-bit symbols: lower-case letters, one space for what lies between, spaces at both ends; empty without a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    out = np.where(letter, np.where(codes > 0xFFFF, 0xE000 + (codes & 0x7FF), codes), _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    out = out[keep]
    return np.concatenate([np.full(1, _SPACE, np.uint64) if letter[np.argmax(keep)] else np.zeros(0, np.uint64), out.astype(np.uint64), np.full(int(out[-1] != _SPACE), _SPACE, np.uint64)])


def keys_of(seq: np.ndarray) -> np.ndarray:
    """Keys of the n-grams of the top order, one for each symbol after the first; the text's start is padded with spaces."""
    padded = np.concatenate([np.full(ORDER - 2, _SPACE, np.uint64), seq])
    out = np.zeros(max(0, len(padded) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | padded[i : len(padded) - ORDER + 1 + i]
    return out


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of `docs` (lang, text): summed in each task, then by n-gram."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for part in slices(batches):
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if len(seq := symbols(text)):
                    found.setdefault(lang, []).append(keys_of(seq))
            for lang, keys in found.items():
                tally.add(lang, np.concatenate(keys))
            if tally.full():
                yield from tally.rows(("lang", "gram", "n"))
        yield from tally.rows(("lang", "gram", "n"))

    usable = docs.select("lang", "text").filter("lang is not null and text is not null")
    return usable.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def _probability(order: int) -> int:
    return order


def _weight(order: int) -> int:
    return ORDER + order


#: Kinds of entries of one model; those of the models without a fold's texts follow, fold by fold.
KINDS = 2 * ORDER + 1


def entries(counts: DataFrame) -> tuple[DataFrame, list[str], np.ndarray, float, list[DataFrame]]:
    """The model's entries (kind, gram, lang, value), the languages, each one's log-probability of an unseen character, the
    bits of a uniform guess and the tables made on the way; `counts` is a written table of lang, gram, n of the top order."""
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct n-grams one longer that end so
        levels[order] = written(levels[order + 1].groupBy("lang", _suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n")))
    alphabet = levels[1].agg(F.count_distinct("gram")).first()[0] + 1
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    discount = F.when((once > 0) & (twice > 0), F.least(F.greatest(once / (once + 2 * twice), F.lit(0.1)), F.lit(0.95))).otherwise(0.5)
    log = lambda p: F.log2(F.greatest(p, F.lit(1e-12)))
    parts, below, made = [], None, [levels[order] for order in range(1, ORDER)]
    for order in range(1, ORDER + 1):
        level = levels[order]
        # a row for each language: their number bounds what is broadcast
        cut = F.broadcast(level.groupBy("lang").agg(discount.alias("discount")))
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
        contexts = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(cut, "lang")
        contexts = contexts.withColumn("gamma", F.col("discount") * F.col("types") / F.col("total"))
        if order == 1:
            unseen = {r.lang: r.gamma / alphabet for r in contexts.collect()}  # a row for each language
            contexts = F.broadcast(contexts)
            lower = F.lit(1.0 / alphabet)
        else:
            parts.append(contexts.select(F.lit(_weight(order)).alias("kind"), F.col("context").alias("gram"), "lang", log(F.col("gamma")).cast("float").alias("value")))
            lower = F.col("p")
        joined = level.withColumn("context", context).join(contexts, ["lang", "context"])
        if below is not None:
            joined = joined.withColumn("suffix", _suffix(F.col("gram"), order - 1)).join(below, ["lang", "suffix"])
        p = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("gamma") * lower
        known = written(joined.select("lang", "gram", p.alias("p")))
        made.append(known)
        parts.append(known.select(F.lit(_probability(order)).alias("kind"), "gram", "lang", log(F.col("p")).cast("float").alias("value")))
        below = known.withColumnRenamed("gram", "suffix")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    langs = sorted(unseen)
    return whole, langs, np.array([np.log2(max(unseen[x], 1e-12)) for x in langs], np.float32), float(np.log2(alphabet)), made


@dataclass
class Models:
    langs: list[str]
    unseen: np.ndarray | None = None  # log2 probability of a character that no language has
    uniform: float = 1.0  # bits a character of a uniform guess over the alphabet
    limits: dict[str, list[float]] = field(default_factory=dict)
    first_kind: int = 0  # of the models' entries

    def asked(self, texts: list[str | None]) -> Asked:
        """The entries that the texts' n-grams may have."""
        keys = [keys_of(s) for t in texts if t and len(s := symbols(t))]
        grams = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        out = {}
        for order in range(1, ORDER + 1):
            own = grams if order == ORDER else distinct(grams & np.uint64((1 << 16 * order) - 1))
            out[self.first_kind + _probability(order)] = own
            if order > 1:
                out[self.first_kind + _weight(order)] = distinct(own >> np.uint64(16))
        return out

    def log_probs(self, entries: Entries, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row for each gram (of the given order), a column for each language."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(grams), len(self.langs)))
        tails, where = np.unique(grams & np.uint64((1 << 16 * (order - 1)) - 1), return_inverse=True)
        out = np.array(self.log_probs(entries, tails, order - 1)[where])
        if order > 1:
            heads, where = np.unique(grams >> np.uint64(16), return_inverse=True)
            rows, cols, values = entries.find(self.first_kind + _weight(order), heads)
            weights = np.zeros((len(heads), len(self.langs)), np.float32)
            weights[rows, cols] = values
            out += weights[where]
        rows, cols, values = entries.find(self.first_kind + _probability(order), grams)
        out[rows, cols] = values
        return out

    def entropies(self, entries: Entries, seqs: list[np.ndarray], of: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
        """Bits a character of each text (a row) under each language (a column); a row without symbols is infinite.

        With `of` and `sizes` the rows are beginnings: the text's number in `seqs`, and how many n-grams are taken from it."""
        keys = [keys_of(s) for s in seqs]
        starts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        if sizes is None:
            of, sizes = np.arange(len(seqs)), np.diff(starts)
        first, last = starts[of], starts[of] + sizes
        out = np.full((len(sizes), len(self.langs)), np.inf)
        if not sizes.sum():
            return out
        grams, where = np.unique(np.concatenate(keys), return_inverse=True)
        table = self.log_probs(entries, grams)
        total = np.zeros(out.shape)
        step = max(1024, CELLS // len(self.langs))
        for at in range(0, len(where), step):
            sums = np.zeros((min(step, len(where) - at) + 1, len(self.langs)))
            np.cumsum(table[where[at : at + step]], axis=0, dtype=np.float64, out=sums[1:])
            lo, hi = np.clip(first - at, 0, len(sums) - 1), np.clip(last - at, 0, len(sums) - 1)
            total += sums[hi] - sums[lo]
        used = sizes > 0
        out[used] = -total[used] / sizes[used, None]
        return out

    def judged(self, entries: Entries, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and acceptance of each text."""
        out = []
        if not self.langs:
            return [(UNDETERMINED, 0.0, None, False)] * len(texts)
        seqs = [symbols(t) if t else np.zeros(0, np.uint64) for t in texts]
        for seq, bits in zip(seqs, self.entropies(entries, seqs), strict=True):
            if not len(seq):
                out.append((UNDETERMINED, 0.0, None, False))
                continue
            bits = np.round(bits, 9)
            best = int(np.argmin(bits))
            # the odds of the best against the rest, over 64 characters at most, so that long texts do not all saturate
            share = 1 / np.exp2(-np.minimum((bits - bits[best]) * min(len(seq), 64), 1000)).sum()
            limit = self.limits.get(self.langs[best])
            accepted = limit is None or bits[best] <= limit[min(int(len(seq)).bit_length(), len(limit) - 1)]
            out.append((self.langs[best], round(float(share), 9), float(bits[best]), bool(accepted)))
        return out


def folded(train: DataFrame) -> DataFrame:
    """lang, text, h and fold of the rows that have a text and a language; copies share a fold."""
    usable = train.select("lang", "text").filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    return usable.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int"))


def _named(number: Column) -> Column:
    """One name for a number of one digit and the row's language."""
    return F.concat(number.cast("string"), F.lit(" "), F.col("lang")).alias("lang")


def model_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n of every model from rows of `folded`: `0 en` counts all of a language's texts, `1 en` those outside fold 0."""
    folds = ngram_counts(rows.select(_named(F.col("fold")), "text"))
    counted_by = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.substring("lang", 1, 1).cast("int") + 1)
    each = folds.select(F.explode(counted_by).alias("model"), F.expr("substring(lang, 3)").alias("lang"), "gram", "n")
    return each.groupBy(_named(F.col("model")), "gram").agg(F.sum("n").alias("n"))


def limits(rows: DataFrame, langs: list[str], folds: list[Models], known: set[str], model: Model) -> dict[str, list[float]]:
    """The rejection limit of each language and range of lengths from all rows of `folded`.

    `folds` has the models without each fold's texts, `model` their entries, and `known` the names of those that counted any."""

    def parts(part: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[str | None, int, str]]]]:
        found: dict[int, list] = {}
        for lang, text, h, fold in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "h", "fold")), strict=True):
            if f"{fold + 1} {lang}" in known:
                found.setdefault(fold, []).append((lang, h, text))
        yield from found.items()

    def asked(part: pa.RecordBatch) -> Asked:
        return {kind: grams for fold, own in parts(part) for kind, grams in folds[fold].asked([text for _, _, text in own]).items()}

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        at = {x: j for j, x in enumerate(langs)}
        out: list[tuple[str, int, int, float]] = []
        for fold, own in parts(part):
            texts = [(lang, h, seq) for lang, h, text in own if len(seq := symbols(text))]
            ends = [(j, n) for j, (_, _, seq) in enumerate(texts) for n in (len(seq), *(3 << i - 2 for i in range(2, min(len(seq).bit_length(), 11))))]
            if ends:
                of, sizes = np.array(ends, np.int64).T
                bits = folds[fold].entropies(entries, [seq for _, _, seq in texts], of, sizes - 1)[np.arange(len(of)), [at[texts[j][0]] for j in of]]
                out += [(*texts[j][:2], n.bit_length(), float(b)) for (j, n), b in zip(ends, np.round(bits, 9), strict=True)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["lang", "h", "size", "bits"])

    seen = model.score(rows, asked, answer, "lang string, h long, size int, bits double").dropDuplicates(["lang", "h", "size"])
    # from here on a row for each step of bits, so that no range of lengths is large, whatever the number of texts
    own = seen.groupBy("lang", "size", F.ceil(F.col("bits") * STEPS).alias("step")).agg(F.count("*").alias("n")).withColumn("spared", F.lit(1))
    pooled = own.groupBy("size", "step").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "spared": F.lit(len(langs))})
    group = Window.partitionBy("lang", "size")
    ranked = own.unionByName(pooled).withColumns({"every": F.sum("n").over(group), "reached": F.sum("n").over(group.orderBy(F.desc("step")))})
    beyond = F.greatest(F.floor(F.col("every") * (1 - QUANTILE)), F.when(F.col("every") >= SPARSE, F.col("spared")).otherwise(0))
    found = ranked.filter(F.col("reached") > beyond).groupBy("lang", "size").agg((F.max("step") / STEPS).alias("high"), F.max("every").alias("n"))
    high = {(r.lang, r["size"]): (r.high, r.n) for r in found.collect()}  # at most RANGES rows a language
    out = {}
    for lang in langs:
        line: list[float | None] = []
        for i in range(RANGES):
            own_high, n = high.get((lang, i), (None, 0))
            pooled_high, every = high.get((None, i), (None, 0))
            limit = [own_high] if n >= FEW else [own_high, pooled_high, line[-1] if line and every < SPARSE else None]
            line.append(max([x for x in limit if x is not None], default=None))
        first = next((x for x in line if x is not None), folds[0].uniform)
        out[lang] = [(first if x is None else x) + MARGIN for x in line]
    return out


def learn(train: DataFrame, bound: int = BROADCAST_ENTRIES) -> tuple[Models, Model]:
    """Models with their rejection limits, and their entries, from rows (text, lang)."""
    rows = folded(train)
    counts = written(model_counts(rows))
    found, names, unseen, uniform, made = entries(counts)
    langs = sorted(x[2:] for x in names if x[0] == "0")
    # FOLDS + 1 rows for each language
    numbers = F.broadcast(local_table(train.sparkSession, [(int(x[0]), langs.index(x[2:]), x) for x in names], "model int, col int, lang string"))
    table = found.join(numbers, "lang").select("model", (F.col("kind") + F.col("model") * KINDS).alias("kind"), "gram", "col", "value")
    own, others = (written(table.filter(which).drop("model")) for which in ("model = 0", "model > 0"))
    drop_written(counts, *made)
    of = dict(zip(names, unseen, strict=True))
    models, *folds = (Models(langs, np.array([of.get(f"{i} {x}", np.log2(1e-12)) for x in langs], np.float32), uniform, first_kind=i * KINDS) for i in range(FOLDS + 1))
    model, without = Model(own, bound), Model(others, bound)
    models.limits = limits(rows, langs, folds, set(names), without)
    if without.shared is None:
        drop_written(others)
    else:
        without.shared.unpersist()
    return models, model


def predict(docs: DataFrame, models: Models, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits and accepted of each row; only the text is looked at."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("accepted", pa.bool_())])

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        rows = models.judged(entries, part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return model.score(docs.select("doc_id", "text"), lambda part: models.asked(part.column("text").to_pylist()), answer, "doc_id long, lang_pred string, score double, bits double, accepted boolean")


def accepted_rows(docs: DataFrame, models: Models, model: Model) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is accepted."""

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        return part.filter(pa.array([r[3] for r in models.judged(entries, part.column("text").to_pylist())], pa.bool_()))

    return model.score(docs, lambda part: models.asked(part.column("text").to_pylist()), answer, docs.schema)


def held_out():
    """The rows that are never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, bound: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits and accepted of each row of `docs` (doc_id, text, lang)."""
    out = predict(docs, *learn(docs.filter(~held_out()), bound))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits", "accepted")
