"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A merge always yields a token of the vocabulary, so two neighbouring bytes that stand side by side inside no token can
never end up in one: a text may be cut there, whatever comes before or after. The whole table of byte pairs is applied
to whole batches of texts at once, as arrays. A cut is taken there if the file's pattern, which splits text before
merges, gives the same on both sides of it: at the start of a character, not before an apostrophe (``'s`` and the like),
and not inside a run of white space nor after one of two or more. Each fragment is encoded independently, each distinct
one once per batch (short ones once per worker), and the fragments' ids are concatenated. Inside a fragment the
pattern's long pieces are cut again at every pair the table allows, which keeps merging linear.

Defined results: null text is empty and has no ids; ids that the vocabulary lacks decode to nothing; bytes that are not
UTF-8 decode to U+FFFD; an empty table gives an empty result; repeated rows stay; other columns are kept, but for one
that has the output's name, which is replaced.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The pattern that splits text before merges, with white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space outside ASCII, as UTF-8.
RARE_SPACE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
KEPT_BYTES = 64
KEPT = 400_000
PART_BYTES = 4 << 20
SLICE_BYTES = 8 << 20


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the file: itself, or the next one from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


PACKS = [struct.Struct(f"<{n}i").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return PACKS[len(ids)](*ids) if len(ids) < len(PACKS) else struct.pack(f"<{len(ids)}i", *ids)


class Codec:
    """Encodes and decodes texts; ids are int32."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or told.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE file without normalizer, prefix space or dropout is needed")
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        self.chars, self.bytes_by_char = {b: c for b, c in enumerate(byte_chars())}, {ord(c): chr(b) for c, b in to_byte.items()}
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in told["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for token, k in model["vocab"].items():
            self.bytes_of[k] = bytes(to_byte[c] for c in token)
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        for content, k in self.added.items():
            self.bytes_of[k] = content.encode()
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        pairs = {t[k : k + 2] for t in self.bytes_of for k in range(len(t) - 1)}
        #: 1 where a pair of bytes (first * 256 + second) stands inside some token.
        self.joins = bytearray(1 << 16)
        for p in pairs:
            self.joins[p[0] << 8 | p[1]] = 1
        self.pattern = regex.compile(PATTERN)
        self.whole = whole = Tokenizer.from_file(path)
        whole.no_padding()
        whole.no_truncation()
        self.merge, self.pre_tokenize = whole.model.tokenize, whole.pre_tokenizer.pre_tokenize_str
        self.ranked = self._by_rank(model)
        self.white = np.zeros(256, dtype=bool)
        self.white[list(b" \t\n\r\f\v")] = True
        self.rare_leads = np.zeros(256, dtype=bool)
        self.rare_leads[[x[0] for x in RARE_SPACE]] = True
        #: Where the pattern allows a cut, too, but for what ``cut_places`` asks of white space.
        self.parts = np.frombuffer(self.joins, dtype=np.uint8).reshape(256, 256) == 0
        self.parts[:, 0x80:0xC0] = False
        self.parts[:, ord("'")] = False
        self.parts = self.parts.ravel()
        self.known: dict[bytes, bytes] = {}

    def _by_rank(self, model: dict) -> tiktoken.Encoding | None:
        """The same merges by rank of their result, which is faster, where ids follow the order of merges.

        A token's own encoding passes through one last pair only, so where all tokens encode to themselves the order
        of results and the order of pairs say the same. Where one does not, the library merges.
        """
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {self.bytes_of[k]: k for k in model["vocab"].values()}
        ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return ranked if all(ranked._encode_single_piece(t) == [k] for t, k in ranks.items()) else None

    def _fragment(self, fragment: bytes) -> bytes:
        if self.ranked:
            return _packed(self.ranked._encode_single_piece(fragment))
        return _packed([t.id for t in self.merge(fragment.decode("latin-1").translate(self.chars))])

    def cuts(self, data: bytes) -> list[int]:
        """Where data may be cut for certain."""
        joins = self.joins
        x = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
        return (np.flatnonzero(np.frombuffer(joins, dtype=np.uint8)[x[:-1] << 8 | x[1:]] == 0) + 1).tolist()

    def _pre_token(self, piece: str | bytes) -> bytes:
        """The ids of one pre-token: its fragments' ids, one after another."""
        data = piece.encode() if isinstance(piece, str) else piece
        if len(data) <= KEPT_BYTES:
            return self._fragment(data)
        at = [0, *self.cuts(data), len(data)]
        return b"".join([self._fragment(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])

    def _apart(self, data: bytes) -> bytes:
        """Ids of a fragment by itself. Rarer characters are left to the library, whose Unicode tables may be of another age than ours."""
        if (data[1:] if data[0] == 32 else data).isalpha():
            return self._pre_token(data)  # ASCII letters are one piece of the pattern
        fragment = data.decode()
        if (fragment[1:] if fragment[0] == " " else fragment).isalpha() and (fragment.isascii() or max(fragment) < "\u0250"):
            return self._pre_token(data)  # and so are others
        if fragment in self.added:
            return _packed([self.added[fragment]])
        if fragment.isascii() or max(fragment) < "\u0250":
            pieces = self.pattern.findall(fragment)
        else:
            pieces = [x.translate(self.bytes_by_char).encode("latin-1") for x, _ in self.pre_tokenize(fragment)]
        return b"".join(map(self._pre_token, pieces))

    def _white(self, data: np.ndarray) -> np.ndarray:
        """Which bytes are white space or part of it."""
        white = self.white.take(data)
        at = np.flatnonzero(self.rare_leads.take(data))
        for x in RARE_SPACE if len(at) else ():
            own = at[at <= len(data) - len(x)]
            for k, byte in enumerate(x):
                own = own[data[own + k] == byte]
            for k in range(len(x)):
                white[own + k] = True
        return white

    def cut_places(self, data: np.ndarray) -> np.ndarray:
        """Where the bytes of whole texts may be cut so that each part, encoded by itself, has the ids it has in the whole."""
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        at = np.flatnonzero(self.parts.take(pair)) + 1
        white = self._white(data)
        return at[~(white[at - 1] & (white[at] | white[np.maximum(at - 2, 0)]))]

    def fragments(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where each fragment starts, for texts whose bytes stand in a row from ``rows`` on; a control string of the file is one."""
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.cut_places(data)] = True
        edge[rows] = True
        if self.special:
            whole = data.tobytes()
            for m in self.special.finditer(whole) if any(x.encode() in whole for x in self.added) else ():
                a, b = m.span()
                if np.searchsorted(rows, a, side="right") == np.searchsorted(rows, b - 1, side="right"):
                    edge[[a, b]] = True
                    edge[a + 1 : b] = False
        return np.flatnonzero(edge[:-1])

    def _encode_distinct(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments, each encoded by itself, and where each one's end."""
        known, out = self.known, []
        if len(known) > KEPT:
            known.clear()
        for x in fragments:
            ids = known.get(x)
            if ids is None:
                ids = self._apart(x)
                if len(x) <= KEPT_BYTES:
                    known[x] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32), np.cumsum(np.fromiter(map(len, out), np.int64, len(out))) >> 2

    def encode_bytes(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose bytes stand in a row, and how many each has; rows has where each starts, and the end."""
        if not len(data):
            return np.empty(0, dtype=np.int32), np.zeros(len(rows) - 1, dtype=np.int64)
        starts = self.fragments(data, rows)
        ends = np.append(starts, len(data))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        _, at, held = coded.dictionary.buffers()
        held, at = held.to_pybytes(), np.frombuffer(at, dtype=np.int64)[: len(coded.dictionary) + 1].tolist()
        ids, stop = self._encode_distinct([held[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        index = coded.indices.to_numpy()
        sizes = np.diff(stop, prepend=0)
        length = sizes.take(index)
        until = np.cumsum(length)
        shift = ((stop - sizes).take(index) - until + length).astype(np.int32)
        at = np.repeat(shift, length)
        at += np.arange(len(at), dtype=np.int32)
        out = ids.take(at)
        return out, np.diff(np.concatenate([[0], until]).take(np.searchsorted(starts, rows)))

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        told = [(t or "").encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(told), dtype=np.uint8), np.cumsum([0, *map(len, told)]))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text of any length, worked on in parts of bounded size."""
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        out, at = [], 0
        while at < len(data):
            to = self._part_end(data, at)
            out.append(self.encode_bytes(data[at:to], np.array([0, to - at]))[0])
            at = to
        return np.concatenate(out) if out else np.empty(0, dtype=np.int32)

    def _part_end(self, data: np.ndarray, at: int) -> int:
        """A certain cut from PART_BYTES on, outside any control string, or the end."""
        longest, size = max([0, *(len(x.encode()) for x in self.added)]), 1 << 16
        while (start := at + PART_BYTES) < len(data):
            near = data[start : start + size]
            found = self.cut_places(near)[1:]  # the first might lack what stands before it
            if self.special and len(found):
                held = np.zeros(len(near) + longest + 1, dtype=bool)
                around = data[max(0, start - longest) : start + size + longest]
                for m in self.special.finditer(around.tobytes()):
                    a, b = (x - min(start, longest) for x in m.span())
                    held[max(a + 1, 0) : max(b, 0)] = True
                found = found[~held[found]]
            if len(found):
                return start + int(found[0])
            if start + size >= len(data):
                break
            size *= 4
        return len(data)

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.max() >= len(self.bytes_of) or ids.min() < 0):
            ids = ids[(ids >= 0) & (ids < len(self.bytes_of))]
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per Python worker and file, kept between tasks."""
    return Codec(path)


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, or one row."""
    at, size = 0, 0
    column = batch.column(text)
    length = [0] if not batch.num_rows else pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for k in range(batch.num_rows):
        if k > at and size + length[k] > most:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += length[k]
    if batch.num_rows > at:
        yield batch.slice(at)


def encode_column(c: Codec, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of texts and how many each row has."""
    if len(column) == 1:
        ids = c.encode(column[0].as_py())
        return ids, np.array([len(ids)])
    filled = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = filled.buffers()
    rows = np.frombuffer(ends, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    return c.encode_bytes(whole[rows[0] : rows[-1]], rows - rows[0])


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)])
    if ends[-1] >= 1 << 31:
        raise ValueError("more than 2^31 ids in one text")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def _fields(df: DataFrame, drop: set[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with ``out_col`` array<int>; no shuffle."""
    rows = docs.drop(out_col) if keep_text else docs.drop(out_col).withColumnRenamed(text_col, text_col)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, at):
                ids = id_lists(*encode_column(c, part.column(at)))
                columns = [(n, x) for k, (n, x) in enumerate(zip(part.schema.names, part.columns, strict=True)) if keep_text or k != at]
                yield pa.RecordBatch.from_arrays([*(x for _, x in columns), ids], names=[*(n for n, _ in columns), out_col])

    kept = _fields(rows, set() if keep_text else {text_col})
    return rows.mapInArrow(run, f"{kept}{', ' if kept else ''}`{out_col}` array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with ``out_col`` string; no shuffle."""
    rows = encoded.drop(out_col)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = pa.array([c.decode(np.asarray(x.values, dtype=np.int32)) if x.is_valid else "" for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, f"{_fields(rows, set())}, `{out_col}` string")


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs without the text, with ``ids`` and the text decoded from them: both ways in one pass over the rows."""
    rows = docs.drop("ids", "decoded")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, at):
                ids, counts = encode_column(c, part.column(at))
                decoded = pa.array([c.decode(x) for x in np.split(ids, np.cumsum(counts)[:-1])], pa.string())
                columns = [(n, x) for k, (n, x) in enumerate(zip(part.schema.names, part.columns, strict=True)) if k != at]
                yield pa.RecordBatch.from_arrays([*(x for _, x in columns), id_lists(ids, counts), decoded], names=[*(n for n, _ in columns), "ids", "decoded"])

    kept = _fields(rows, {text_col})
    return rows.mapInArrow(run, f"{kept}{', ' if kept else ''}ids array<int>, decoded string")


def ids_digest(ids: str = "ids"):
    """Column: hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)


