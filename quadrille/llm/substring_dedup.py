"""Substring dedup by hashing lines or paragraphs.

A text is cut into units: lines with their run of line ends, or paragraphs, which end with an empty line. As an option,
units are sentences: lines cut further after each run of ``.!?``, which finds a passage inside a line too, but for its
first unit where the text before it doesn't end. Each unit of ``min_words`` words or more is
normalised (lower case, white space to single blanks) and hashed to 128 bits; digests are grouped globally; the
occurrence with the smallest (document id, row, place) stays, and the others are removed. Offsets are those of the original
text, in code points, ends exclusive.

With ``whole`` (the pipeline; op6's SQL fixes the units above) repeats are found that units alone miss: a character of a
script without blanks counts as a word, and units end at its full stops too; short units between two units are hashed
together with both; and of the text's ``SHINGLE``-word windows those are hashed that have the least hash among
``REACH`` in a row, wherever sentences end. Equal runs of ``SHINGLE + REACH - 1`` = 50 words or more share such a window,
so none is missed, and less than ``REACH`` words of it stay at either edge. A window that repeats inside one unit only stays.
Windows have digests of 64 bits.

Only digests that occur more than once are joined back to the units, in a join whose hot digests Spark may split; the
grouping combines map-side.

Defined results: null and empty texts have no units and stay as they are; a null id ranks last; of repeated rows the
first by row number keeps its text and the rest lose it; a text may become empty but no row goes; an empty table gives
an empty result; all other columns stay, but for ``removed``.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged, unstage

UNITS = {
    "line": re.compile(r"[^\n]*\n+|[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]+\n?)*\n+|(?:[^\n]+\n?)+"),
    "sentence": re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"),
}
MIN_WORDS = 5
#: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
NO_BLANKS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{NO_BLANKS}]|[^\s{NO_BLANKS}]+")
ANY_UNIT = re.compile(r"[^.!?\n\u3002\uff01\uff1f]*[.!?\n\u3002\uff01\uff1f]+|[^.!?\n\u3002\uff01\uff1f]+")
SHINGLE, REACH = 25, 26
BASE = 0x9E3779B97F4A7C15
WORDS_KEPT = 200_000
_word_hashes: dict[str, int] = {}


def units_of(text: str, min_words: int = MIN_WORDS, unit: str = "line") -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit with enough words."""
    for m in UNITS[unit].finditer(text):
        words = m[0].lower().split()
        if len(words) >= min_words:
            yield m.start(), m.end(), hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def passages_of(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, digest, start of the unit) of each unit, of short units between two units, and of the text's windows."""
    starts, before, short = [], None, []
    for m in ANY_UNIT.finditer(text):
        starts.append(m.start())
        words = m[0].lower().split()
        norm = " ".join(words)
        if len(words) >= min_words or (not norm.isascii() and len(TOKEN.findall(norm)) >= min_words):
            yield m.start(), m.end(), _digest(norm), m.start()
            if short and before is not None:
                yield short[0][0], short[-1][1], _digest("\n".join([before, *(x for _, _, x in short), norm])), short[0][0]
            before, short = norm, []
        elif norm:
            short.append((m.start(), m.end(), norm))
    yield from _windows(text, np.array(starts))


def _word_hash(word: str) -> int:
    found = _word_hashes.get(word)
    if found is None:
        if len(_word_hashes) >= WORDS_KEPT:
            _word_hashes.clear()
        found = _word_hashes[word] = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest())
    return found


def _windows(text: str, starts: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n < SHINGLE + REACH - 1:
        return
    power, back = (np.cumprod(np.full(n, b, dtype=np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
    hashes = np.fromiter((_word_hash(text[a:b]) for a, b in spans), np.uint64, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
    found = (sums[SHINGLE:] - sums[:-SHINGLE]) * back[: n - SHINGLE + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(BASE)
    found ^= found >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(found, REACH).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    first = np.array([spans[k][0] for k in at.tolist()])
    unit = starts[np.searchsorted(starts, first, side="right") - 1]
    for k, a, u in zip(at.tolist(), first.tolist(), unit.tolist(), strict=True):
        yield a, spans[k + SHINGLE - 1][1], found[k].tobytes(), u


def units(rows: DataFrame, min_words: int = MIN_WORDS, whole: bool = False, unit: str = "line") -> DataFrame:
    """(rid, id, start, stop, digest) for rows(rid, id, text), and with whole the unit's start as ``part``; no shuffle."""

    names = ["rid", "id", "start", "stop", "digest", *(["part"] if whole else [])]
    cut = passages_of if whole else functools.partial(units_of, unit=unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, told = [], []

            def out() -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                start, stop, digest, *part = zip(*told, strict=True)  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(digest, pa.binary()), *(pa.array(x, pa.int32()) for x in part)], names=names)  # noqa: B023

            for k in range(batch.num_rows):
                for x in cut(batch.column(2)[k].as_py() or "", min_words):
                    row.append(k)
                    told.append(x)
                    if len(row) >= 50_000:
                        yield out()
                        row, told = [], []
            if row:
                yield out()

    kinds = f"rid long, id {rows.schema['id'].dataType.simpleString()}, start int, stop int, digest binary" + (", part int" if whole else "")
    return rows.select("rid", "id", "text").mapInArrow(run, kinds)


def repeats(found: DataFrame) -> DataFrame:
    """(rid, start, stop) of every unit that is not the earliest of its digest, nor in the unit of the earliest."""
    part = "part" if "part" in found.columns else "start"
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "rid", "start", *([part] if part != "start" else []))
    # Counts alone first: they are narrow, and few units occur twice.
    # Stored, they don't bind the joins to their own exchange, so Spark may split the rows of a hot digest.
    often = staged(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "often")
    twice = staged(found.join(often, "digest"), "repeated")
    first = staged(twice.groupBy("digest").agg(F.min(rank).alias("first")), "first")
    again = twice.join(first, "digest").where((F.col("rid") != F.col("first.rid")) | (F.col(part) != F.col(f"first.{part}")))
    return again.select("rid", "start", "stop")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, whole: bool = False, unit: str = "line") -> DataFrame:
    """docs with their texts cut, and ``removed``: array of (start, stop) in the original text, in order; it replaces a column of that name."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    rid, given = free_name(docs, "rid"), docs.drop("removed")
    rows = staged(given.withColumn(rid, F.monotonically_increasing_id()), "texts")
    found = staged(units(rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_words, whole, unit), "units")
    spans = repeats(found).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed")).withColumnRenamed("rid", rid)
    if whole:  # the windows go before texts are shuffled
        spans = staged(spans, "spans")
        unstage(found)
    joined = rows.join(spans, rid, "left").drop(rid)
    at, last = joined.columns.index(text_col), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(last).to_pylist()
            spans = [merged([(x["start"], x["stop"]) for x in s or []]) for s in spans]
            cut = [cut_out(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(cut, batch.schema.field(at).type)
            columns[last] = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], batch.schema.field(last).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return joined.mapInArrow(run, joined.schema)
