"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A stripe holds whole documents in ascending order of id; its ids are cut into blocks of ``BLOCK``, and a block knows
nothing of any other. For each next id three orders predict: order 2 gives the ids that followed the last two ids,
order 1 those that followed the last one, each with counts, and order 0 is a distribution over the block's alphabet.
They are mixed into one distribution: each named id gets a share of it, learnt from how often the id in that place came
true where the counts were alike, ids that both orders name get both shares, and order 0 shares out the rest. It drives
a 48-bit range coder with carries, one step an id.

A block is cut into lanes, stretches that are coded side by side as numpy arrays, each by a range coder of its own, while
all lanes of the block learn and share one model: a step codes the next id of every lane, then the model learns them all.
Blocks of a stripe are worked on side by side too, each with tables, streams and checksum of its own. A lane's words go
into its block's stream in the order in which the reader asks for them.

Stripe, little-endian: ``QTK4``, number of blocks, CRC-32 of the block table (u32 each), the block table with ids, lanes,
bytes of the alphabet, bytes of the words and CRC-32 of the ids as u32 (u32 each) per block, then each block's alphabet (gaps
between its ids, deflated) and words. The table of stripes also has the documents' ids and lengths.

Defined results: null and empty texts are the end id alone; null ids come first; rows with equal ids follow each other
in order of the text's hash; an empty table gives an empty file; a block that fails its checksum raises an error, or
with ``bad="null"`` costs only the documents that have ids in it. Document ids may be of any type that Spark can sort
and Arrow can hold.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import codec, encode_column, slices
from .common import staging_root

MAGIC = b"QTK4"
BLOCK = 1 << 16
LANES = 192
LANE_IDS = 64
STEPS = 1 << 12  # a lane has no more ids, so that counts fit
STRIPE_IDS = 1 << 21
END_ID = 0
MOST = 1 << 16  # ids are below this
NAMED = 4  # ids that are named: one by order 2, the others by order 1
ROW = np.complex128  # a row of four 32-bit numbers, which numpy moves as one
SLOTS = 16  # bits of a block's table of order 2
COUNT = 17  # a named id and its count are one number, count << COUNT | id
MIX_BITS = 26
#: Counts fall into classes that start here; a pair of classes and two questions are a case of the mixing.
CLASSES = np.array([1, 2, 3, 5, 9, 20])
CASES = 7 * 7 * 2 * 2
LEAST = 1 << 10  # share of a named id at least
WORD = 16
LOW = (1 << 48) - 1
FLOOR = 1 << 32


class _Model:
    """What the lanes of each block have learnt together, for blocks side by side; made anew for each block.

    Of each lane, row 0 of ``told``, ``ids``, ``share`` and ``end`` is what order 2 names, the others what order 1 names.
    """

    def __init__(self, widths: np.ndarray, lanes: int):
        self.widths, self.wide, blocks = widths, int(widths.max()), len(widths)
        block = np.repeat(np.arange(blocks), lanes)
        n = len(block)
        self.bits0 = 16 if self.wide <= 1 << 13 else 18
        self.at0 = block * (self.wide + 1)
        self.base1, self.base2, self.base_case = block * self.wide, block << SLOTS, block * CASES
        self.most = (widths - 1).take(block).astype(np.int32)
        self.named2 = np.full(blocks << SLOTS, self.wide, dtype=np.int32)
        self.named1 = np.full((blocks * self.wide, NAMED), self.wide, dtype=np.int32).view(ROW).ravel()
        self.every = np.arange(n)
        classes = np.searchsorted(CLASSES, np.arange(1 << 13), side="right").astype(np.uint8)
        self.classes2, self.classes14 = 2 * classes, 14 * classes
        case = np.arange(CASES)
        sure2, sure1 = case // 14 % 7, case % 14 // 2
        came = np.full((NAMED + 1, CASES), 2, dtype=np.int64)
        came[0] = np.where(sure2 > 0, 2 + 4 * sure2 * sure2, 0)
        came[1] = np.where(sure1 > 0, 2 + 2 * sure1 * sure1, 0)
        came[-1] = 16
        self.came = np.tile(came, blocks)
        self.seen = np.zeros((blocks, self.wide), dtype=np.int64)
        self.last, self.mark = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.uint32)
        self.told, self.ids, self.share, self.end = (np.empty((NAMED, n), dtype=np.int32) for _ in range(4))
        self.row = np.zeros((n, NAMED), dtype=np.int32)
        self.steps, self.due = 0, 1
        self.new_cases: list[np.ndarray] = []  # counted when the next mix, the next fresh0 needs them
        self.new_ids: list[np.ndarray] = []
        self.mix()
        self.fresh0()

    def mix(self) -> None:
        """The named ids' shares of the whole in each case; order 0 has the rest."""
        if self.new_cases:
            self.came += 8 * np.bincount(np.concatenate(self.new_cases), minlength=self.came.size).reshape(self.came.shape)
            self.new_cases = []
        left = (1 << MIX_BITS) - (1 << self.bits0 + 2) - LEAST * NAMED
        shares, total = np.empty((self.came.shape[1], NAMED), dtype=np.int32), self.came.sum(axis=0)
        for k in range(NAMED):
            shares[:, k] = _over(self.came[k] * left, total) + LEAST
        self.shares = shares.view(ROW).ravel()

    def fresh0(self) -> None:
        """The distribution of order 0, from the ids that no other order named: where each id's share begins."""
        if self.new_ids:
            self.seen += np.bincount(np.concatenate(self.new_ids), minlength=self.seen.size).reshape(self.seen.shape)
            self.new_ids = []
        of_all = np.cumsum(2 * self.seen + 1, axis=1) * ((1 << self.bits0) - self.widths)[:, None]
        begin = np.zeros((len(self.widths), self.wide + 1), dtype=np.int64)
        begin[:, 1:] = _over(of_all, (2 * self.seen.sum(axis=1) + self.widths)[:, None]) + np.arange(1, self.wide + 1)
        self.begin0, self.places = begin.ravel(), None

    def by_place(self) -> np.ndarray:
        """For each block the id that holds each place of order 0."""
        if self.places is None:
            begin = self.begin0.reshape(len(self.widths), -1)
            self.places = np.concatenate([np.repeat(np.arange(n, dtype=np.uint16), np.diff(own[: n + 1])) for n, own in zip(self.widths.tolist(), begin, strict=True)])
        return self.places

    def look(self) -> None:
        """The ids that order 2 and order 1 name, their shares and where each share ends, of all lanes."""
        told, ids, share, end = self.told, self.ids, self.share, self.end
        self.at2 = (((self.last.view(np.uint32) * 40503) ^ self.mark) & ((1 << SLOTS) - 1)) + self.base2
        self.at1 = self.last + self.base1
        self.named2.take(self.at2, out=told[0], mode="clip")
        told[1:] = self.named1.take(self.at1).view(np.int32).reshape(-1, NAMED)[:, : NAMED - 1].T
        np.bitwise_and(told, (1 << COUNT) - 1, out=ids)
        count = told[:3] >> COUNT
        both = ids[1:] == ids[0]
        case = self.classes14.take(count[0])
        case += self.classes2.take(count[1])
        case += (count[2] << 1) > count[1]
        case += both[0].view(np.uint8) * np.uint8(CASES // 2)
        self.case = self.base_case + case
        share[:] = self.shares.take(self.case).view(np.int32).reshape(-1, NAMED).T
        moved = share[1:] * both
        share[1:] -= moved
        for x in moved:
            share[0] += x
        end[0] = share[0]
        for k in range(1, NAMED):
            np.add(end[k - 1], share[k], out=end[k])

    def chosen(self, kind: np.ndarray) -> np.ndarray:
        """Where the named id of each kind stands in ``ids``, ``share`` and ``end``; the last one where none is meant."""
        at = np.multiply(np.minimum(kind, NAMED - 1), len(kind), dtype=np.int64)
        at += self.every
        return at

    def coded(self, at: np.ndarray, rest: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of each lane's id starts, and the share; rest: the lanes whose id only order 0 has."""
        share = self.share.ravel().take(at)
        start, share = (self.end.ravel().take(at) - share).astype(np.int64), share.astype(np.int64)
        own, end = self.at0.take(rest) + now.take(rest), self.end[-1].take(rest)
        share0 = (1 << MIX_BITS) - end.astype(np.int64)
        first = (share0 * self.begin0.take(own)) >> self.bits0
        own += 1
        share[rest] = ((share0 * self.begin0.take(own)) >> self.bits0) - first
        start[rest] = end + first
        return start, share

    def learn(self, now: np.ndarray, kind: np.ndarray, rest: np.ndarray, known: np.ndarray) -> None:
        """now: the ids that came; kind: which named id that was, or how many there are if none; known: which named ids it equals."""
        told = self.told
        counted = np.multiply(kind, self.came.shape[1], dtype=np.int64)
        counted += self.case
        self.new_cases.append(counted)
        self.new_ids.append(self.base1.take(rest) + now.take(rest))
        told += np.multiply(known, 1 << COUNT, dtype=np.int32)
        weakest = told[:: NAMED - 1]  # of order 2 and of order 1: one less where none came true, or replaced
        change = (now + (2 << COUNT)) - weakest
        change *= weakest < 2 << COUNT
        change -= 1 << COUNT
        change[0] *= ~known[0]
        change[1] *= ~np.logical_or.reduce(known[1:])
        weakest += change
        for k in range(NAMED - 1, 1, -1):  # the highest count first
            high = np.maximum(told[k - 1], told[k])
            np.minimum(told[k - 1], told[k], out=told[k])
            told[k - 1] = high
        self.named2[self.at2] = told[0]
        for k in range(1, NAMED):
            self.row[:, k - 1] = told[k]
        self.named1[self.at1] = self.row.view(ROW).ravel()
        self.last, self.mark = now, self.last.view(np.uint32) * 30011 >> 2
        self.steps += 1
        if self.steps < 32 or self.steps % 8 == 0:
            self.mix()
        if self.steps >= self.due:
            self.fresh0()
            self.due = max(self.steps + 1, self.steps * 5 // 4)


class _Writer:
    """Range coders of all lanes; each lane's words stand in a row of their own, along which carries go."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, dtype=np.int64), np.full(lanes, LOW, dtype=np.int64)
        self.words, self.room, self.free = np.zeros(lanes * room, dtype=np.uint16), room, room
        self.next = np.arange(lanes) * room
        self.places: list[np.ndarray] = []  # of words, in the order in which they were made

    def _make_room(self) -> None:
        """Rows of twice the length, if any is full."""
        lanes, room = len(self.low), self.room
        self.free = room - int((self.next - np.arange(lanes) * room).max())
        if not self.free:
            self.free, self.room = room, 2 * room
            self.words = np.pad(self.words.reshape(lanes, room), ((0, 0), (0, room))).ravel()
            self.next += np.arange(lanes) * room
            self.places = [x + x // room * room for x in self.places]

    def _emit(self, at: np.ndarray) -> None:
        if not self.free:
            self._make_room()
        low, place = self.low.take(at), self.next.take(at)
        self.words[place] = low >> 32
        self.places.append(place)
        self.next[at] = place + 1
        self.low[at] = (low << WORD) & LOW
        self.free -= 1

    def put(self, start: np.ndarray, share: np.ndarray) -> None:
        """Narrow every lane to its share of the whole, from start."""
        unit = self.range >> MIX_BITS
        self.low += unit * start
        self.range = unit * share
        over, small = np.flatnonzero(self.low > LOW), np.flatnonzero(self.range < FLOOR)
        if len(over):
            self.low[over] &= LOW
            word = self.next.take(over) - 1
            while len(word):
                self.words[word] += np.uint16(1)
                word = word[self.words.take(word) == 0] - 1
        while len(small):
            self._emit(small)
            span = self.range.take(small) << WORD
            self.range[small] = span
            small = small[span < FLOOR]

    def finish(self, blocks: int) -> list[bytes]:
        """Each block's words as the reader asks for them: three of each lane first, then at each step a lane's third next."""
        lanes = len(self.low)
        for _ in range(3):
            self._emit(np.arange(lanes))
        first = np.arange(lanes) * self.room
        place = np.concatenate([first, first + 1, first + 2, *(x + 3 for x in self.places[:-3])])
        words = self.words.take(place)
        block = (place // (lanes // blocks * self.room)).astype(np.uint16 if blocks > 256 else np.uint8)  # so short that the sort is by radix
        words = words.take(np.argsort(block, kind="stable"))
        ends = np.cumsum(np.bincount(block, minlength=blocks))[:-1]
        return [x.astype("<u2").tobytes() for x in np.split(words, ends)]


class _Reader:
    """Range decoders of all lanes; words that a spoilt block lacks are zero."""

    def __init__(self, data: list[bytes], lanes: int):
        words = [np.frombuffer(x[: len(x) & ~1], dtype="<u2") for x in data]
        short = [np.zeros(max(0, 3 * lanes - len(x)), dtype="<u2") for x in words]
        words = [np.concatenate(x) for x in zip(words, short, strict=True)]
        self.code = np.concatenate([x[:lanes].astype(np.int64) << 32 | x[lanes : 2 * lanes].astype(np.int64) << 16 | x[2 * lanes : 3 * lanes] for x in words])
        size = np.array([len(x) for x in words])
        self.end = np.cumsum(size)
        self.at = self.end - size + 3 * lanes
        self.words, self.lanes = np.concatenate([*words, np.zeros(1, dtype="<u2")]).astype(np.int64), lanes
        self.range = np.full(len(self.code), LOW, dtype=np.int64)

    def place(self) -> np.ndarray:
        self.unit = self.range >> MIX_BITS
        return np.clip(self.code / self.unit, 0, (1 << MIX_BITS) - 1).astype(np.int32)  # beyond that only in spoilt blocks

    def take(self, start: np.ndarray, share: np.ndarray) -> None:
        """As ``_Writer.put``."""
        self.code -= self.unit * start
        self.range = self.unit * share
        small = np.flatnonzero(self.range < FLOOR)
        while len(small):
            block = small // self.lanes
            n = np.bincount(block, minlength=len(self.at))
            at = (self.at - np.cumsum(n) + n).take(block) + np.arange(len(small))
            self.at += n
            at = np.where(at < self.end.take(block), at, len(self.words) - 1)
            self.code[small] = self.code.take(small) << WORD | self.words.take(at)
            span = self.range.take(small) << WORD
            self.range[small] = span
            small = small[span < FLOOR]


def _over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """floor(x / y); exact, as x and each multiple of y stay below 2^53."""
    return (x / y).astype(np.int64)


def encode_blocks(blocks: list[np.ndarray], widths: list[int]) -> tuple[int, list[bytes]]:
    """The lanes and each block's words, for blocks with ids below their widths, none longer than the first; lanes are filled up with zeros."""
    n = len(blocks[0])
    lanes = max(min(LANES, max(1, n // LANE_IDS)), n // STEPS)
    steps = -(-n // lanes)
    padded = np.zeros((len(blocks), lanes, steps), dtype=np.int32)
    for k, x in enumerate(blocks):
        own = -(-len(x) // lanes)  # a shorter block's zeros come after all its ids, in every lane
        padded[k, :, :own] = np.pad(x, (0, lanes * own - len(x))).reshape(lanes, own)
    model, out = _Model(np.array(widths, dtype=np.int64), lanes), _Writer(len(blocks) * lanes, steps + 4)
    for now in np.ascontiguousarray(padded.reshape(len(blocks) * lanes, -1).T):
        model.look()
        known = model.ids == now
        hit = known.view(np.uint8)
        kind = hit[0] ^ 1
        kind *= NAMED - sum(hit[k] * (NAMED - k) for k in range(1, NAMED))
        rest = np.flatnonzero(kind == NAMED)
        out.put(*model.coded(model.chosen(kind), rest, now))
        model.learn(now, kind, rest, known)
    return lanes, out.finish(len(blocks))


def decode_blocks(data: list[bytes], lanes: int, longest: int, counts: list[int], widths: list[int]) -> list[np.ndarray]:
    """The ids of blocks of counts ids that were written beside one of the longest."""
    blocks, steps = len(data), -(-longest // lanes)
    model, source = _Model(np.array(widths, dtype=np.int64), lanes), _Reader(data, lanes)
    out = np.empty((steps, blocks * lanes), dtype=np.int32)
    base0 = np.repeat(np.arange(blocks) << model.bits0, lanes)
    for step in range(steps):
        model.look()
        place = source.place()
        kind = np.add.reduce((place >= model.end).view(np.uint8), axis=0, dtype=np.uint8)
        rest = np.flatnonzero(kind == NAMED)
        at = model.chosen(kind)
        now = model.ids.ravel().take(at)
        end = model.end[-1].take(rest)
        place0 = _over(((place.take(rest) - end + 1).astype(np.int64) << model.bits0) - 1, (1 << MIX_BITS) - end)
        now[rest] = model.by_place().take(place0 + base0.take(rest))
        np.minimum(now, model.most, out=now)  # a spoilt block keeps to its own tables
        source.take(*model.coded(at, rest, now))
        out[step] = now
        model.learn(now, kind, rest, model.ids == now)
    every = out.T.reshape(blocks, lanes, steps)
    return [x[:, : -(-n // lanes)].ravel()[:n] for x, n in zip(every, counts, strict=True)]


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The ids that occur, and the gaps between them, low bytes first, deflated."""
    found = np.flatnonzero(np.bincount(ids, minlength=1))
    gaps = np.diff(found, prepend=0).astype("<u2")
    return found, zlib.compress(gaps.view(np.uint8).reshape(-1, 2).T.tobytes(), 9)


def write_stripe(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One stripe of the file format."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < MOST:
        raise ValueError(f"ids must be from 0 to {MOST - 1}")
    cuts = [ids[k : k + block] for k in range(0, len(ids), block)]
    alphabets = [_alphabet(x) for x in cuts]
    dense = [np.searchsorted(a, x) if len(x) < MOST >> 4 else _dense(a, x) for (a, _), x in zip(alphabets, cuts, strict=True)]
    lanes, words = encode_blocks(dense, [len(a) for a, _ in alphabets]) if cuts else (1, [])
    told, bodies = [], []
    for own, (_, alphabet), body in zip(cuts, alphabets, words, strict=True):
        told.append(struct.pack("<IIIII", len(own), lanes, len(alphabet), len(body), zlib.crc32(own.astype("<u4").tobytes())))
        bodies += [alphabet, body]
    table = b"".join(told)
    return b"".join([MAGIC, struct.pack("<II", len(cuts), zlib.crc32(table)), table, *bodies])


def _dense(alphabet: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = np.zeros(MOST, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return place.take(ids)


def read_blocks(data: bytes) -> list[tuple[int, np.ndarray | None]]:
    """(number of ids, ids) of each block of a stripe; None for a block that fails its checksum."""
    if data[:4] != MAGIC or len(data) < 12:
        raise ValueError("not a stripe of token ids")
    n, crc = struct.unpack_from("<II", data, 4)
    table = data[12 : 12 + 20 * n]
    if len(table) < 20 * n or zlib.crc32(table) != crc:
        raise ValueError("the block table fails its checksum")
    told, at = [struct.unpack_from("<IIIII", table, 20 * k) for k in range(n)], 12 + 20 * n
    found: list[np.ndarray | None] = [None] * n
    alike: dict[int, list[tuple[int, np.ndarray, bytes]]] = {}
    for k, (_, lanes, gaps, size, _) in enumerate(told):
        try:
            raw = np.frombuffer(zlib.decompress(data[at : at + gaps]), dtype=np.uint8)
            alphabet = np.cumsum(raw[: len(raw) & ~1].reshape(2, -1).T.copy().view("<u2").ravel().astype(np.int64))
            if len(alphabet):
                alike.setdefault(lanes, []).append((k, alphabet, data[at + gaps : at + gaps + size]))
        except (zlib.error, ValueError):
            pass  # found stays None
        at += gaps + size
    for lanes, own in alike.items():
        dense = decode_blocks([x for _, _, x in own], lanes, told[0][0], [told[k][0] for k, _, _ in own], [len(a) for _, a, _ in own])
        for (k, alphabet, _), x in zip(own, dense, strict=True):
            ids = alphabet.take(x).astype(np.int32)
            if zlib.crc32(ids.astype("<u4").tobytes()) == told[k][4]:
                found[k] = ids
    return [(t[0], x) for t, x in zip(told, found, strict=True)]


def read_stripe(data: bytes) -> np.ndarray:
    """The ids of a stripe; every block is checked."""
    out = []
    for k, (_, ids) in enumerate(read_blocks(data)):
        if ids is None:
            raise ValueError(f"block {k} fails its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, stripe_ids: int = STRIPE_IDS, block: int = BLOCK) -> None:
    """Write the files: rows (part, stripe, ids, lengths, n_ids, data), in ascending order of document ids by part and stripe.

    Ranges of ids are dealt by Spark's range partitioning, with the text's hash as second key, so that one id with many
    rows can be spread. A document of more ids than a stripe has one of its own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    arrow_kind = to_arrow_type(kind)
    schema = pa.schema([("part", pa.int32()), ("stripe", pa.int32()), ("ids", pa.list_(arrow_kind)), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, stripe = codec(tokenizer), TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            every, own = np.concatenate(lengths), pa.concat_arrays([x.cast(arrow_kind) for x in names])
            columns = [pa.array([part], pa.int32()), pa.array([stripe], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([every], pa.list_(pa.int64())), pa.array([size]), pa.array([write_stripe(np.concatenate(held), block)], pa.binary())]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for piece in slices(batch, 1):
                ids, counts = encode_column(c, piece.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                ends = np.cumsum(counts + 1)
                at = 0  # documents of the piece that are held or written
                while at < len(ends):
                    before = int(ends[at - 1]) if at else 0
                    to = max(int(np.searchsorted(ends, before + stripe_ids - size, side="right")), at + (not size))
                    if to > at:
                        names.append(piece.column(0).slice(at, to - at))
                        held.append(ids[before : ends[to - 1]])
                        lengths.append(counts[at:to] + 1)
                        size += int(ends[to - 1]) - before
                    if to < len(ends):
                        yield out()
                        names, held, lengths, size, stripe = [], [], [], 0, stripe + 1
                    at = to
        if held:
            yield out()

    order = rows.orderBy(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    order.mapInArrow(run, f"part int, stripe int, ids array<{kind.simpleString()}>, lengths array<bigint>, n_ids long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """(id, start, ids) of every document, from the files; start counts the ids of all documents before it.

    bad: ``raise`` an error for a block that fails its checksum, or ``null`` for the documents with ids in it.
    """
    return _read(spark, path, "array<int>", bad, lambda ids, cuts: [x.astype(np.int32) for x in np.split(ids, cuts)], pa.list_(pa.int32()))


def read_checks(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """(id, start, ids) as ``read``, but ids is a struct of their number and unsigned CRC-32."""
    kind = pa.struct([("n", pa.int64()), ("crc32", pa.int64())])

    def made(ids: np.ndarray, cuts: np.ndarray) -> list[dict[str, int]]:
        data, at = ids.astype("<u4").tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
        return [{"n": (b - a) >> 2, "crc32": zlib.crc32(data[a:b])} for a, b in zip(at[:-1], at[1:], strict=True)]

    return _read(spark, path, "struct<n: bigint, crc32: bigint>", bad, made, kind)


def _read(spark: SparkSession, path: str, kind: str, bad: str, made, arrow_kind: pa.DataType) -> DataFrame:
    if bad not in ("raise", "null"):
        raise ValueError("bad must be raise or null")
    files = spark.read.parquet(path)
    id_kind = files.schema["ids"].dataType.elementType.simpleString()
    # Ids before a stripe: those of earlier parts (a number for each part comes to the driver), and of earlier stripes.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, known = 0, []
    for r in parts:
        known.append((r.part, base))
        base += r.n
    bases = spark.createDataFrame(known, "part int, base long")
    earlier = Window.partitionBy("part").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "stripe", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    starts = starts.join(F.broadcast(bases), "part").select("part", "stripe", (F.col("base") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, data = batch.column(3)[k].values.to_numpy(), batch.column(4)[k].as_py()
                ends = np.cumsum(lengths)
                blocks = read_blocks(data) if bad == "null" else [(0, read_stripe(data))]
                ids = np.concatenate([np.full(n, -1, dtype=np.int32) if x is None else x for n, x in blocks])
                told = made(ids, ends[:-1])
                lost = np.flatnonzero(np.logical_or.reduceat(ids < 0, ends - lengths)) if bad == "null" else ()
                for j in lost:
                    told[j] = None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[k].values, pa.array(ends - lengths), *(pa.array(np.full(len(lengths), batch.column(c)[k].as_py(), dtype=np.int32)) for c in (0, 1)), pa.array(told, arrow_kind)],
                    names=["id", "at", "part", "stripe", "ids"],
                )

    docs = files.select("part", "stripe", "ids", "lengths", "data").mapInArrow(run, f"id {id_kind}, at long, part int, stripe int, ids {kind}")
    return docs.join(starts, ["part", "stripe"]).select("id", (F.col("base") + F.col("at")).alias("start"), "ids")


def new_path(spark: SparkSession) -> str:
    """A new folder for files in the cluster's shared folder."""
    return f"{staging_root(spark)}/token-files-{uuid.uuid4().hex[:12]}"
