"""Fill-in-middle transformation: a text is cut at two unit boundaries and put together anew, prefix, suffix and middle.

A unit is a run of other characters with the white space before it, or white space at the end. An Arrow-batched pandas
UDF finds the units with the regex library, keeps their end offsets in a compact array and slices the text by two
look-ups; hashlib gives the seeds and the digests. A row depends on its doc_id and text alone, so there is no shuffle, and
a lost task is made again with the same result.

Results: a null or empty text has no units and is plain; a null doc_id is seeded by the empty string; repeated rows and
ties give a row each; extra columns, whatever their names, are not read; an empty table gives no rows. A text that holds
one of the markers stays plain, so that the original text can always be rebuilt.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Possessive: a unit never gives characters back, so that long white space costs linear time.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rates:
    """Shares in hundredths: of texts that are transformed, and of spm among these; `seed` makes another drawing."""

    transformed: int = 50
    spm: int = 80
    seed: str = "42"


@dataclass(frozen=True)
class Cut:
    """A transformed text, and what its parts were."""

    n: int
    form: str
    output: str
    prefix_chars: int | None = None
    middle_chars: int | None = None


def unit_ends(text: str) -> array:
    """The offset behind each unit, 8 bytes a unit, with 0 first."""
    ends = array("q", [0])
    ends.extend(found.end() for found in UNIT.finditer(text))
    return ends


def draws(doc_id: str, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(doc_id: str, text: str, rates: Rates) -> Cut:
    ends = unit_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, rates.seed)
    if not n or h3 % 100 >= rates.transformed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, PLAIN, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, last = ends[low], ends[high]
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < rates.spm:
        return Cut(n, SPM, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", first, last - first)
    return Cut(n, PSM, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", first, last - first)


def restore(output: str, form: str) -> str:
    """The original text from a transformed one and its form."""
    if form == PLAIN:
        return output
    inner = SUFFIX if form == PSM else PREFIX
    one, _, rest = output[len(PREFIX) :].partition(inner)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return prefix + middle + suffix


def _inputs() -> tuple:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))


def _applied(docs: DataFrame, rates: Rates, more: str, extra: Callable[[Cut], tuple]) -> DataFrame:
    """doc_id, n, form, prefix_chars and middle_chars of each row, and the columns `more` that `extra` makes of its cut."""

    @pandas_udf(f"n long, form string, prefix_chars long, middle_chars long, {more}")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ["n", "form", "prefix_chars", "middle_chars", *(x.split()[0] for x in more.split(", "))]
        for ids, texts in batches:
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                made = transform(doc_id, text, rates)
                rows.append((made.n, made.form, made.prefix_chars, made.middle_chars, *extra(made)))
            yield pd.DataFrame(rows, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.select("doc_id", cut(*_inputs()).alias("r")).select("doc_id", "r.*")


def fill_in_middle(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text, `output`, of each row of `docs`."""
    return _applied(docs, rates, "output string", lambda made: (made.output,))


def digests(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """As `fill_in_middle`, with digests of the output and of the text rebuilt from it instead of the output."""

    def sha256(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    return _applied(docs, rates, "output_sha256 string, restored_sha256 string", lambda made: (sha256(made.output), sha256(restore(made.output, made.form))))
