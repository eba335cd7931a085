"""Periodic runs of words by grammar-compressed run detection, and texts without their repeated periods.

Texts are cut into words, numbered apart in each document, and compressed by Re-Pair: pairs of neighbouring symbols that
occur twice or more become nonterminals. Pairs are replaced in rounds over a whole batch of documents as arrays: of
overlapping pairs the more frequent one (by powers of two, then at random) is replaced, so the number of rounds
grows with the logarithm of the text. A pair that occurs once never occurs again and bounds two symbols of the start rule.

A run lies across the boundary of exactly one smallest rule that holds all of it. So the runs across each nonterminal's
boundary are worked out once, at its first derivation, within its expansion, and carried to all places that derive it;
those across the start rule's boundaries are worked out within the document. Stretches of one period that share a
period's length are merged, and of equal stretches the smallest period stays. A nonterminal shorter than the shortest
run has none to look for. A run of ``TIMES`` periods has half its length on one side of the boundary, so a period q can only
be one at which a stretch of at least q / 2 words beside the boundary repeats: such stretches are looked up
by their length's power of two among those that repeat in the document, and extended by the same tables.

A document is worked on by one task, in memory that grows with its words times the logarithm of its longest repeat.

Defined results: null and empty texts have no words and no runs, and collapse to an empty text; a null id is carried along;
repeated rows each get their own result; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

MIN_LENGTH, TIMES = 24, 3
#: Words that are worked on at once, about; a longer document is a group of its own.
GROUP_WORDS = 1 << 18
#: Candidate periods that are extended at once.
CANDIDATES = 1 << 20
#: What separates words, as a pattern for Spark.
BLANKS = r"[\x20\x09-\x0D]+"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row and where each text's begin, one more number at the end; blanks are space and \\t to \\r."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    if isinstance(cut, pa.ChunkedArray):
        cut = cut.combine_chunks()
    words, begin = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    begin = begin - begin[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # blanks at the ends of a text leave empty words
        words, begin = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[begin]
    return words, begin


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and how often its key occurs, by place."""
    number, _ = pd.factorize(keys)
    return number, np.bincount(number)


def compress(codes: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over documents in a row; codes differ between documents and last marks their final words.

    (borders, rule, start, left): the places where a symbol of a start rule begins but the first of each, and of every
    derivation of a nonterminal of ``least`` words or more its number, place and the words of its left part; its length
    is in ``rule``'s second row.
    """
    symbol, start = codes.astype(np.int64), np.arange(len(codes))
    size, closed = np.ones(len(codes), dtype=np.int64), last.copy()
    free, rng = int(symbol.max(initial=0)) + 1, np.random.default_rng(11)
    borders, rules = [], []
    while True:
        pair = np.flatnonzero(~closed[:-1])
        number, count = _counted(symbol[pair] * free + symbol[pair + 1])
        once = count[number] < 2
        closed[pair[once]] = True
        borders.append(start[pair[once] + 1])
        pair, number = pair[~once], number[~once]
        if not len(pair):
            break
        ahead = (np.log2(count).astype(np.int64) << 40) + rng.permutation(len(count)) + 1
        weight = np.zeros(len(symbol) + 1, dtype=np.int64)
        weight[pair] = ahead[number]
        # Equal pairs in a row, as in aaaa, are one stretch, of which every other pair is taken.
        heads = np.flatnonzero(np.concatenate([[True], weight[1:] != weight[:-1]]))
        own = weight[heads]
        best = (own > np.concatenate([[0], own[:-1]])) & (own > np.concatenate([own[1:], [0]]))
        ends = np.concatenate([heads[1:], [len(weight)]])
        taken = (ends - heads + 1)[best] // 2
        chosen = np.repeat(heads[best] - 2 * (np.cumsum(taken) - taken), taken) + 2 * np.arange(taken.sum())
        place = np.zeros(len(symbol), dtype=np.int64)
        place[pair] = number
        symbol[chosen] = free + place[chosen]
        left = size[chosen].copy()
        size[chosen] += size[chosen + 1]
        closed[chosen] = closed[chosen + 1]
        long = size[chosen] >= least
        rules.append(np.stack([symbol[chosen], size[chosen], start[chosen], left])[:, long])
        keep = np.ones(len(symbol), dtype=bool)
        keep[chosen + 1] = False
        symbol, start, size, closed = symbol[keep], start[keep], size[keep], closed[keep]
        free += len(count)
        alone = closed & np.concatenate([[True], closed[:-1]])  # done: it takes part in no further pair
        symbol, start, size, closed = symbol[~alone], start[~alone], size[~alone], closed[~alone]
        if not len(symbol):
            break
    found = np.concatenate([np.empty((4, 0), dtype=np.int64), *rules], axis=1)
    return np.concatenate(borders), found[:2], found[2], found[3]


def repeated_stretches(codes: np.ndarray) -> list[np.ndarray]:
    """For each k a number for the stretch of 2^k words at each place, -1 where it occurs once in its document."""
    number, count = _counted(codes)
    levels = [np.where(count[number] > 1, number, -1).astype(np.int32)]
    while True:
        here, width = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero((here[:-width] >= 0) & (here[width:] >= 0)) if len(here) > width else np.empty(0, dtype=np.int64)
        number, count = _counted(here[at].astype(np.int64) * len(codes) + here[at + width])
        again = count[number] > 1 if len(at) else np.empty(0, dtype=bool)
        if not again.any():
            return levels
        level = np.full(len(codes), -1, dtype=np.int32)
        level[at[again]] = number[again]
        levels.append(level)


def _extent(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i and j on, or before both, are equal; at most ``most``."""
    got = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero(got + (1 << k) <= most)
        step = -got[at] - (1 << k) if back else got[at]
        one = levels[k][i[at] + step]
        got[at[(one >= 0) & (one == levels[k][j[at] + step])]] += 1 << k
    return got


def _candidates(levels: list[np.ndarray], border: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which border, i, q): a run of period q across the border may hold i and i + q, where i is the border or q before it."""
    n, most_q = len(levels[0]), (hi - lo) // TIMES
    first = int(np.log2(max(1, -(-((min_length + 1) // 2) // 3))))
    for k in range(first, len(levels)):
        width, shortest, longest = 1 << k, 1 if k == first else 2 << k, (4 << k) - 1
        level = levels[k]
        at = np.flatnonzero(level >= 0)
        places = np.sort(level[at].astype(np.int64) * n + at)
        for right in (True, False):
            own = np.flatnonzero((most_q >= shortest) & ((border + width <= hi) if right else (border - width >= lo)))
            begin = border[own] if right else border[own] - width
            own, begin = own[level[begin] >= 0], begin[level[begin] >= 0]
            code, reach = level[begin].astype(np.int64) * n, np.minimum(longest, most_q[own])
            a, b = (begin + shortest, np.minimum(begin + reach, n - 1)) if right else (np.maximum(begin - reach, 0), begin - shortest)
            some = a <= b
            own, begin, code, a, b = own[some], begin[some], code[some], a[some], b[some]
            lower, upper = np.searchsorted(places, code + a), np.searchsorted(places, code + b, side="right")
            count = upper - lower
            total = np.cumsum(count)
            for part in np.split(np.arange(len(own)), np.searchsorted(total, np.arange(CANDIDATES, total[-1], CANDIDATES)) if len(total) else []):
                if not len(part) or not (sent := int(count[part].sum())):
                    continue
                which = np.repeat(part, count[part])
                inside = np.arange(sent) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                q = np.abs(places[lower[which] + inside] - code[which] - begin[which])
                yield own[which], border[own[which]] - (0 if right else q), q


def runs_across(levels: list[np.ndarray], border: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which border, (start, end, period)) of runs across each border within lo to hi; one run may come more than once."""
    which, found = [np.empty(0, dtype=np.int64)], [np.empty((3, 0), dtype=np.int64)]
    for own, i, q in _candidates(levels, border, lo, hi, min_length):
        fits = (i >= lo[own]) & (i + q <= hi[own])
        own, i, q = own[fits], i[fits], q[fits]
        end = i + q + _extent(levels, i, i + q, hi[own] - i - q, back=False)
        start = i - _extent(levels, i, i + q, i - lo[own], back=True)
        run = (end - start >= np.maximum(min_length, TIMES * q)) & (start < border[own]) & (end > border[own])
        which.append(own[run])
        found.append(np.stack([start[run], end[run], q[run]]))
    return np.concatenate(which), np.concatenate(found, axis=1)


def merged(runs: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end, period), by start, then period, from stretches of them."""
    if not runs.shape[1]:
        return runs
    start, end, q = runs[:, np.lexsort((runs[0], runs[2]))]
    far = int(end.max()) + 1
    apart = np.cumsum(np.concatenate([[0], q[1:] != q[:-1]])) * far
    reached = np.maximum.accumulate(end + apart)
    new = np.concatenate([[True], (start + apart)[1:] > reached[:-1] - q[1:]])
    heads = np.flatnonzero(new)
    start, end, q = start[heads], np.maximum.reduceat(end, heads), q[heads]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    start, end, q = start[least], end[least], q[least]
    order = np.lexsort((q, start))
    return np.stack([start, end, q])[:, order]


def runs_of(codes: np.ndarray, begin: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, end, period) of the runs of documents in a row, places counted through; codes are words, begin where documents start."""
    n = len(codes)
    if not n:
        return np.empty((3, 0), dtype=np.int64)
    sizes = np.diff(begin)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    number, _ = pd.factorize(doc * (int(codes.max()) + 1) + codes)
    last = np.zeros(n, dtype=bool)
    last[begin[1:][sizes > 0] - 1] = True
    levels = repeated_stretches(number)
    borders, (rule, length), start, left = compress(number, last, min_length)
    _, found = runs_across(levels, borders, begin[doc[borders]], begin[doc[borders] + 1], min_length)
    # Each nonterminal once, at its first derivation; then wherever it is derived.
    order = np.lexsort((start, rule))
    rule, length, start, left = rule[order], length[order], start[order], left[order]
    first = np.flatnonzero(np.concatenate([[True], rule[1:] != rule[:-1]])) if len(rule) else np.empty(0, dtype=np.int64)
    which, inside = runs_across(levels, start[first] + left[first], start[first], start[first] + length[first], min_length)
    times = np.diff(np.concatenate([first, [len(rule)]]))[which]
    at = np.repeat(first[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    moved = start[at] - np.repeat(start[first[which]], times)
    derived = np.repeat(inside, times, axis=1) + np.stack([moved, moved, np.zeros_like(moved)])
    return merged(np.concatenate([found, derived], axis=1))


def _group(words: pa.Array, begin: np.ndarray, min_length: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each document and its text without repeated periods."""
    codes = words.dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy().astype(np.int64)
    start, end, q = runs_of(codes, begin, min_length)
    change = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(change, start + q, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    if not kept.all():
        words, shorter = words.filter(pa.array(kept)), np.concatenate([[0], np.cumsum(kept)])[begin]
    else:
        shorter = begin
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(shorter), words), pa.scalar(" ", words.type))
    doc = np.searchsorted(begin, start, side="right") - 1
    rows = pa.StructArray.from_arrays([pa.array(start - begin[doc]), pa.array(end - start), pa.array(q)], names=["start", "length", "period"])
    offsets = np.searchsorted(doc, np.arange(len(begin)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows), text


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) of each row, runs by start, then period.

    A run is a stretch of at least ``min_length`` words and TIMES periods that no neighbouring word extends, with its smallest
    period. ``collapsed`` has the words but those that a run holds after its first period, joined by one blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, begin = split_words(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(begin, begin[at] + GROUP_WORDS, side="right")) - 1)
                own = begin[at : to + 1]
                runs, text = _group(words.slice(own[0], own[-1] - own[0]), own - own[0], min_length)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(own)), runs, text.cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])
                at = to

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def longest_by_periods(runs: Column) -> Column:
    """Of runs as ``find_runs`` gives them that with the greatest length / period, the first of equal ones; null if there is none."""
    more = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(more(a, x), x).otherwise(a)))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with periodic endings in a tenth of the texts, chosen by id: a known input for measuring run detection.

    With h the CRC-32 of the decimal id and g = h // 10, a text of n words with h % 10 = 0 keeps its first a = g % n words and
    repeats the p = 1 + (n - a) // (3 + g % 8) words after those up to its length.
    """
    words, h = free_name(docs, "words"), F.crc32(F.col(id_col).cast("string").cast("binary"))
    div = lambda x, y: F.call_function("div", x, y)
    g = div(h, F.lit(10))
    rows = docs.withColumn(words, F.when(h % 10 == 0, F.array_remove(F.split(text_col, BLANKS), "")))
    n = F.nullif(F.size(words).cast("long"), F.lit(0))
    a = g % n
    p = div(n - a, g % 8 + 3) + 1
    tail = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = div(n - a + p - 1, p)
    ending = F.slice(F.flatten(F.array_repeat(tail, times.cast("int"))), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), ending), " ")
    return rows.withColumn(text_col, F.when(F.size(words) > 0, planted).otherwise(F.col(text_col))).drop(words)
