"""Licence scans: a positional index of rare licence words, and mandatory phrases to verify.

Only DataFrame functions. Every word of every template is indexed with its positions. A file looks up its licence words of
the highest inverse document frequency (over all files): for each template so many of its words that are in the file that a
place with at least `MIN_SHARE` of the words standing must have one of them at its position (what may be missing, less what
the file does not have at all, plus one). Each word found proposes by its postings where the template would begin; a
template of which the file lacks too many words is not looked up. At a proposed place each mandatory phrase of the template
must stand word for word, and `MIN_SHARE` of all its words at theirs. So no place that fits is missed, whatever the other
documents hold. Everything after the frequencies is one narrow stage.

Results: a null or empty text has no words, no labels and score 0; overlapping and repeated notices each count as places,
labels are distinct; equal rows are judged alike; null ids give rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urlfilter import LOWER, UPPER

BLANKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum() and i != 32)
MIN_SHARE = 0.8

# Phrases of the base rule and their labels (fixed values).
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


# Notices of public licences (fixed values): label, words, phrases that must stand at their place.
TEMPLATES = (
    Template("agpl-3.0", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("artistic-2.0", "under the terms of the artistic license 2 0", ("artistic license 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "either version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty", ("provided as is without any express or implied warranty",)),
)


def words_column(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased: all else becomes a blank, at which a text is cut."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + BLANKS, LOWER + " " * len(BLANKS)), " "), "")


def texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def stands(words: Column, start: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand from `start` on."""
    out = F.lit(True)
    for i, word in enumerate(phrase):
        out = out & F.coalesce(F.get(words, start + i) == word, F.lit(False))
    return out


def places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase; the words are only walked where all of the phrase's words occur."""
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), lambda i: stands(words, i, phrase))
    present = F.size(words) >= len(phrase)
    for word in sorted(phrase, key=len, reverse=True):
        present = present & F.array_contains(words, word)
    return F.when(present, found).otherwise(F.array().cast("array<int>"))


def document_frequencies(worded: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows with each word of the vocabulary: at most one row a word comes to the driver."""
    # array_intersect is distinct: one row for each word of a document
    found = worded.select(F.explode(F.array_append(F.array_intersect("words", texts(vocabulary)), F.lit(""))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, also where it is used within a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def score_of(words: Column, here: Column, template: Template, idf: dict[str, float]) -> Column:
    """The highest share of the template's words at their places, 0 where no verified place has MIN_SHARE of them. here: the
    file's licence words."""
    line = template.text.split()
    ranked = sorted(set(line), key=lambda w: (-idf[w], w))
    allowed = len(line) - math.ceil(MIN_SHARE * len(line) - 1e-9)
    share = lambda s: sum((F.when(F.get(words, s + i) == w, F.lit(1)).otherwise(F.lit(0)) for i, w in enumerate(line)), F.lit(0)) / F.lit(float(len(line)))

    def verified(s: Column) -> Column:
        out = F.lit(True)
        for phrase in template.mandatory:
            part = phrase.split()
            at = next(i for i in range(len(line)) if line[i : i + len(part)] == part)
            out = out & stands(words, s + at, part)
        return out

    def best(asked: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(asked, F.get(words, i)))
        proposed = F.flatten(F.transform(near, lambda i: F.transform(F.element_at(postings_of(line), F.get(words, i)), lambda at: i - at)))
        return F.coalesce(F.array_max(F.transform(F.filter(proposed, verified), share)), F.lit(0.0))

    def looked_up(own: Column) -> Column:
        spare = F.lit(allowed - len(line)) + F.aggregate(own, F.lit(0), lambda n, w: n + F.element_at(counts_of(line), w))
        return F.when(spare >= 0, let(F.slice(own, 1, spare + 1), best)).otherwise(F.lit(0.0))

    # a place can be verified only where every word of the mandatory phrases is
    possible = F.lit(True)
    for word in sorted({w for phrase in template.mandatory for w in phrase.split()}, key=lambda w: (-idf[w], w)):
        possible = possible & F.array_contains(here, word)
    found = let(F.array_intersect(texts(ranked), here), looked_up)  # in order of IDF
    return F.when(possible, F.when(found >= MIN_SHARE - 1e-9, found).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def counts_of(line: list[str]) -> Column:
    return F.create_map(*(F.lit(x) for w in sorted(set(line)) for x in (w, line.count(w))))


def postings_of(line: list[str]) -> Column:
    """Positions of each word of a template."""
    return F.create_map(*(x for w in sorted(set(line)) for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(line) if v == w)))))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of `docs` (doc_id, text)."""
    worded = docs.select("doc_id", words_column(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    rows, counts = document_frequencies(worded, vocabulary)
    idf = {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    words = F.col("words")
    here = F.array_intersect(texts(sorted(vocabulary, key=lambda w: (-idf[w], w))), words)
    found = worded.select("doc_id", "words", here.alias("here"), *(places(words, phrase.split()).alias(f"b{i}") for i, (phrase, _) in enumerate(base)))
    shares = [score_of(words, F.col("here"), t, idf) for t in templates]
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), *(f"b{i}" for i in range(len(base))), *(s.alias(f"s{i}") for i, s in enumerate(shares)))
    all_ = F.concat(*(F.col(f"b{i}") for i in range(len(base))))
    labels = [F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(base)]
    more = [F.when(F.col(f"s{i}") > 0, F.lit(t.label)) for i, t in enumerate(templates)]
    text = lambda parts: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), ",")
    return found.select(
        "doc_id", "n_words", F.size(all_).cast("long").alias("n_base"), F.array_min(all_).cast("long").alias("first_word"), F.array_max(all_).cast("long").alias("last_word"),
        text(labels).alias("base_labels"), text(labels + more).alias("labels"), F.greatest(*(F.col(f"s{i}") for i in range(len(templates)))).alias("score"),
    )
