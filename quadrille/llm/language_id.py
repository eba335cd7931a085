"""Language identification with word-first backoff.

A word is a letter (Unicode category L) with the letters and combining marks after it, in lower case; training and
prediction cut texts by one function. A known word scores by its log frequency in each language; an unseen one falls
back to its character n-grams, the longest known first: at each place the longest n-gram that the model has, down to one
character, counts. Words are walked whole; one of more than ``LONG`` characters counts as a word for each ``LONG``. The
language with the highest sum wins; the score is its share of the softmax of mean scores.

The model is fitted on a bounded sample of labelled rows, drawn by language: all rows of a language with few, and of the
others about as many each as make ``max_rows`` rows and ``max_chars`` characters in all. Rows are drawn by a hash of all
their columns, so copies of a text are drawn apart where they have an id. Languages with a sampled word are the
candidates. All words and n-grams of the sample are in the model, which has an entry for each of them and each language
it occurs in: its size is bounded by the sample's, so it may be broadcast.

Defined results: null texts and those without a letter (digits, number forms, signs, marks alone) are ``und`` with score
0; a model without any label calls everything ``und``; equal scores go to the first language by name; labels that are
null are not learned from; repeated rows get equal results; an empty table gives an empty result; other columns stay, but
for those that have an output's name, which are replaced.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

MAX_ROWS = 4_000
MAX_CHARS = 1 << 24
N_MAX = 4
SIZES = tuple(range(N_MAX, 0, -1))
SMOOTH = 0.5
UNKNOWN = "und"
PIECE = 1 << 20
LONG = 64
#: N-grams of a long word are looked up for so many places at a time.
PLACES = 1024
#: Unseen words whose n-grams a worker remembers.
KEPT = 100_000
BROADCAST_LANGS = 100_000


@functools.lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """A word, the same in texts without characters beyond U+FFFF, and the rest of a word that has begun.

    From Python's table of Unicode categories.
    """
    kind = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    ranges = lambda kinds, end: "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"[{kinds}]+", kind[:end]))
    word = [re.compile(f"[{ranges('L', end)}][{ranges('LM', end)}]*") for end in (None, 1 << 16)]
    return word[0], word[1], re.compile(f"[{ranges('LM', None)}]*")


ASCII_WORD = re.compile("[a-z]+")
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _words(text: str) -> list[str]:
    text = text.lower()
    if text.isascii():
        return ASCII_WORD.findall(text)
    whole, short, _ = patterns()
    return (whole if BEYOND.search(text) else short).findall(text)


def words_of(text: str) -> Counter:
    """How often each word occurs; long texts are worked on in pieces that end between words."""
    if len(text) <= PIECE:
        return Counter(_words(text))
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        to = patterns()[2].match(text, min(at + PIECE, len(text))).end()
        counts.update(_words(text[at:to]))
        at = to
    return counts


class Table:
    """For each key, by how much its log frequency in the languages it occurs in exceeds that of an absent key, ``base``."""

    def __init__(self, keys: list[str], key_langs: list[int], counts: list[int], n_langs: int):
        self.index = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        order = np.argsort(at, kind="stable")
        n = np.array(counts, dtype=np.float64)
        self.lang, self.gain = np.array(key_langs, dtype=np.int64)[order], np.log((n + SMOOTH) / SMOOTH)[order]
        self.size = np.bincount(at, minlength=len(self.index))
        self.start = np.cumsum(self.size) - self.size
        total = np.bincount(key_langs, weights=n, minlength=n_langs) if len(keys) else np.zeros(n_langs)
        self.base = np.log(SMOOTH / (total + SMOOTH * (len(self.index) + 1)))

    def scores(self, keys: list[int], weights: list[float]) -> np.ndarray:
        """Weighted sum of the keys' log frequencies in each language."""
        at, weight = np.array(keys, dtype=np.int64), np.array(weights, dtype=np.float64)
        size = self.size.take(at)
        until = np.cumsum(size)
        place = np.repeat(self.start.take(at) - until + size, size) + np.arange(until[-1] if len(until) else 0)
        return weight.sum() * self.base + np.bincount(self.lang.take(place), weights=np.repeat(weight, size) * self.gain.take(place), minlength=len(self.base))


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: Table
    unseen: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"unseen": {}}

    def backoff(self, padded: str, places: range) -> list[int]:
        """At each of these places of an unseen word the longest n-gram that is known, if any."""
        grams, found = self.grams.index.get, []
        for at in places:
            for size in SIZES:
                k = grams(padded[at : at + size])
                if k is not None:
                    found.append(k)
                    break
        return found

    def remembered(self, word: str) -> list[int]:
        found = self.unseen.get(word)
        if found is None:
            if len(self.unseen) >= KEPT:
                self.unseen.clear()
            found = self.unseen[word] = self.backoff(f"^{word}$", range(len(word) + 1))
        return found

    def scores(self, text: str) -> tuple[np.ndarray, float]:
        """Sum of log scores by language, and the number of words; an unseen word scores the mean over its places."""
        words, times, grams, share = [], [], [], []
        total, number = np.zeros(len(self.langs)), 0.0
        index = self.words.index.get
        for w, n in words_of(text).items():
            k, weight = index(w), n if len(w) <= LONG else n * len(w) / LONG
            number += weight
            if k is not None:
                words.append(k)
                times.append(weight)
            elif len(w) <= LONG:
                found = self.remembered(w)
                grams += found
                share += [weight / (len(w) + 1)] * len(found)
            else:
                for lo in range(0, len(w) + 1, PLACES):
                    found = self.backoff(f"^{w}$", range(lo, min(lo + PLACES, len(w) + 1)))
                    total += self.grams.scores(found, [weight / (len(w) + 1)] * len(found))
        return total + self.words.scores(words, times) + self.grams.scores(grams, share), number

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        total, n = self.scores(text)
        if not n:
            return UNKNOWN, 0.0
        mean = total / n
        best = int(np.argmax(mean))
        share = np.exp(np.clip((mean - mean[best]) * min(n, 50), -700, 0))
        return self.langs[best], float(1 / share.sum())


def sampled(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(text, lang) of the rows to learn from: of each language about an equal part of max_rows and of max_chars.

    What languages with few rows leave of their parts goes to the others.
    """
    keys = [c for c, kind in labelled.dtypes if "map<" not in kind and "variant" not in kind]
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(*keys), F.lit(1 << 31)).alias("at")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text").cast("double")).alias("chars"))
    counts, parts = staged(counts, "languages"), {}
    languages = counts.count()
    for c, most in (("n", max_rows), ("chars", max_chars)):
        each = most / max(1, languages)
        few = counts.agg(F.sum(F.when(F.col(c) <= each, F.col(c))).alias("all"), F.count(F.when(F.col(c) > each, 1)).alias("others")).first()
        parts[c] = (most - (few["all"] or 0)) / max(1, few["others"])
    below = F.least(F.lit(1.0), parts["n"] / F.col("n"), parts["chars"] / F.greatest(F.lit(1.0), F.col("chars"))) * (1 << 31)
    shares = counts.select("lang", below.alias("below"))
    # A language may hold most rows, so rows don't move to meet its share, unless there are too many languages to broadcast.
    return rows.join(F.broadcast(shares) if languages <= BROADCAST_LANGS else shares, "lang").where("at < below").select("text", "lang")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Learns from rows with a label; the sample's words and n-grams come to the driver counted by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counts = words_of(batch.column(0)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(1)[k].as_py()] * len(counts), pa.string()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "key", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: Counter = Counter()
            for lang, key, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                padded = f"^{key}$"
                for size in SIZES:
                    for at in range(len(padded) - size + 1):
                        grams[lang, padded[at : at + size]] += n
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in grams], pa.string()), pa.array([x for _, x in grams], pa.string()), pa.array(grams.values(), pa.int64())], names=["lang", "key", "n"])

    kind, summed = "lang string, key string, n long", lambda df: df.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = staged(summed(sampled(labelled, text_col, lang_col, max_rows, max_chars).mapInArrow(run, kind)), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    place = {lang: k for k, lang in enumerate(langs)}

    def table(counted: DataFrame) -> Table:
        told = counted.orderBy("key", "lang").toArrow()
        return Table(told.column("key").to_pylist(), [place[x] for x in told.column("lang").to_pylist()], told.column("n").to_pylist(), len(langs))

    found = Model(langs, table(words), table(summed(words.mapInArrow(cut, kind))))
    unstage(words)
    return found


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1, which replace columns of their names; no shuffle."""
    rows = docs.drop(lang_out, score_out)
    at = rows.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            told = [m.predict(t.as_py()) for t in batch.column(at)]
            lang, score = pa.array([x for x, _ in told], pa.string()), pa.array([y for _, y in told], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, score], names=[*batch.schema.names, lang_out, score_out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, `{lang_out}` string, `{score_out}` double")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: CRC-32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
