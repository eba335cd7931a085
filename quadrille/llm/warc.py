"""WARC files: written with revisit records for repeated payloads, and read by boundary-chain verification.

Writing: Spark's text writer makes the files, a record a row, with the record's closing line ends as line separator. Rows with
equal payloads (same SHA-1, length and XXH64) are found by narrow rows; payloads don't travel for that. Payload
digests that may hold more than a small share of the rows are found by Misra-Gries and their winners broadcast, as in ``exact_dedup``.

Reading: Spark's text reader cuts files at the version line that begins a record, in any number of splits, wherever it
stands: in a payload too. Each piece after such a line is a candidate; its header tells where its record ends, so tasks
emit its offset and its successor's. Within a split candidates are chained by pointer jumping to the offset at which they
leave it; of these exits, a few a split, a small table is made, on which pointer jumping from the file's start finds
the one place where the true chain enters each split, in as many rounds as the number of splits of the largest file
has binary digits. From there the records of the split are marked. A version line inside a payload is never
reached; the pieces it cut are put together again. Only such pieces are shuffled with their contents.

Defined results: a null payload is empty; a null id ranks lowest and is read back as null; of equal payloads of
``min_bytes`` or more the row with the largest id is the response, of repeated rows one of them; a null URI has no header
and line ends in one are percent-encoded; an empty table gives files without records, which read as an empty table; other columns are not looked at.
A file whose chain does not end at its end is an error, or with bad="keep" gives the whole records up to the break.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, staging_root, unstage
from .exact_dedup import SUPPORT, heavy_winners

MAGIC = "WARC/1.1\r\n"
LINE, END = "\r\n", "\r\n\r\n"
MAX_HEADER = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes as 32 upper-case base32 characters: four for each 20 bits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), *BASE32)


def _losers(rows: DataFrame, min_bytes: int, support: float) -> DataFrame:
    """(row, first): rows that repeat the payload of another, which is told; rows: (row, id, key, bytes), a stored table."""
    rows = rows.where(F.col("bytes") >= min_bytes).select("row", "id", "key")
    rank = F.struct("id", "row")
    heavy = F.broadcast(staged(heavy_winners(rows, "key", rank, support), "heavy"))
    frequent = rows.join(heavy, "key").select("row", F.col("winner.row").alias("first"))
    rest = rows.join(heavy, "key", "left_anti").select("row", F.max(rank).over(Window.partitionBy("key"))["row"].alias("first"))
    return frequent.unionByName(rest).where("row <> first")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", support: float = SUPPORT) -> None:
    """Write a record per row: a response with an HTTP message around the payload, or a revisit of the response that has an equal one."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload")).withColumns({"row": F.monotonically_increasing_id(), "bytes": F.octet_length("payload"), "digest": base32_sha1(F.col("payload"))})
    rows = staged(rows.withColumn("key", F.concat_ws(":", "digest", "bytes", F.hex(F.xxhash64("payload")))), "payloads")
    losers = staged(_losers(rows, min_bytes, support), "revisits")
    told = rows.join(losers, "row", "left")
    again = F.col("first").isNotNull()
    uri = F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record_id = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit(MAGIC), _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", record_id(F.col("row"))), _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", uri),
        _header("WARC-Page-ID", F.col("id").cast("string")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Refers-To", record_id(F.col("first"))), _header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", size.cast("string")), F.lit(LINE),
    )
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    told.select(F.concat(head, http, body).alias("value")).write.option("lineSep", END).text(path)
    for table in (rows, losers):
        unstage(table)


def _field(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(value != "", value)


def pieces_of(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """(file, split, piece, value, bytes, step): what stands between two version lines; pieces are numbered in the order of the split.

    step: how far on the next record begins if the piece begins one; null if it has no header of a record.
    """
    lines = spark.read.option("lineSep", magic).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    head = F.substring_index("value", END, 1)
    size = F.octet_length(head)
    length = F.when((size < F.col("bytes")) & (size <= MAX_HEADER), _field(head, "Content-Length")).try_cast("long")
    step = length + size + (len(magic) + 2 * len(END))
    counted = lines.withColumns({"piece": F.monotonically_increasing_id(), "bytes": F.octet_length("value").cast("long")})
    return counted.withColumn("step", F.when(length < 1 << 50, step))


def _jumped(after: np.ndarray) -> np.ndarray:
    """The last place of each chain, by pointer jumping; after: the next place, or -1."""
    last = np.where(after < 0, np.arange(len(after)), after)
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _reached(after: np.ndarray, first: int) -> np.ndarray:
    """Which places the chain from ``first`` visits, by pointer jumping."""
    seen = np.zeros(len(after), dtype=bool)
    seen[first] = True
    jump = np.where(after < 0, np.arange(len(after)), after)
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more == seen).all():
            return seen
        seen, jump = more, jump[jump]


def _places(table: pa.Table, magic: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a split's pieces, in order: their numbers, records' offsets in the file, the offsets of their successors (-1: none), the places of these in the split (-1: elsewhere), and ends of pieces."""
    table = table.sort_by("piece")
    piece, size, base = (table.column(c).to_numpy() for c in ("piece", "bytes", "base"))
    end = base + np.cumsum(size + magic)
    offset = end - size - 2 * magic
    step = table.column("step").fill_null(-1).to_numpy()
    then = np.where(step < 0, -1, offset + step)
    at = np.searchsorted(offset, then)
    at = np.where((at < len(offset)) & (offset[np.minimum(at, len(offset) - 1)] == then), at, -1)
    return piece, offset, then, at, end - magic


def records_of(pieces: DataFrame, magic: str = MAGIC, bad: str = "raise") -> DataFrame:
    """(file, record, value): the records of a stored table of pieces that a chain from their file's start reaches; record is the offset."""
    if bad not in ("raise", "keep"):
        raise ValueError("bad must be raise or keep")
    spark, m = pieces.sparkSession, len(magic)
    sizes = pieces.groupBy("file", "split").agg(F.sum(F.col("bytes") + m).alias("size"))
    order = Window.partitionBy("file").orderBy("split")
    base = staged(sizes.select("file", "split", (F.sum("size").over(order) - F.col("size")).alias("base"), (F.sum("size").over(Window.partitionBy("file")) - m).alias("file_bytes")), "split-offsets")
    narrow = staged(pieces.select("file", "split", "piece", "bytes", "step").join(base, ["file", "split"]), "candidates")

    def exits(table: pa.Table) -> pa.Table:
        piece, offset, then, at, _ = _places(table, m)
        out = then[_jumped(at)]
        good = (then >= 0) & (out >= 0)
        rows = table.slice(0, int(good.sum()))  # the split's names, as often as needed
        return pa.table({"file": rows.column("file"), "split": rows.column("split"), "here": offset[good], "there": out[good]})

    chains = staged(narrow.groupBy("file", "split").applyInArrow(exits, "file string, split long, here long, there long"), "exits")
    entered = chains.select("file", F.col("there").alias("here")).distinct()
    hops = staged(chains.join(entered, ["file", "here"], "left_semi").select("file", "here", "there").unionByName(chains.where("here = 0").select("file", "here", "there")).distinct(), "hops")
    reached = chains.where("here = 0").select("file", "here").distinct()
    most = base.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most - 1).bit_length() if most > 1 else 0):
        onward = reached.join(hops, ["file", "here"]).select("file", F.col("there").alias("here"))
        reached = staged(reached.unionByName(onward).distinct(), "reached")
        twice = hops.select("file", "here", F.col("there").alias("via")).join(hops.select("file", F.col("here").alias("via"), "there"), ["file", "via"], "left")
        hops = staged(twice.select("file", "here", F.coalesce("there", "via").alias("there")), "hops")
    entries = chains.join(reached, ["file", "here"]).select("file", "split", "here")

    def marked(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pieces that are no whole records: those of a record in several pieces, and those of none (record null)."""
        piece, offset, then, at, end = _places(left, m)
        if not len(piece):
            return pa.table({c: pa.array([], t) for c, t in (("file", pa.string()), ("split", pa.int64()), ("piece", pa.int64()), ("record", pa.int64()), ("last", pa.int64()))})
        seen = np.zeros(len(piece), dtype=bool)
        for here in right.column("here").to_pylist():
            seen |= _reached(at, int(np.searchsorted(offset, here)))
        whole_file = left.column("file_bytes")[0].as_py()
        seen &= (then >= 0) & (then <= whole_file)
        own = np.maximum.accumulate(np.where(seen, np.arange(len(piece)), -1))
        alone = seen & (then == end)
        # A record that goes on to another piece is told with all of its pieces; -1: it may have begun in an earlier split, -2: none.
        record = np.where(own < 0, -1, np.where(offset < then[own], offset[own], -2))
        odd = np.flatnonzero(~alone)
        last, names = int(offset[seen].max()) if seen.any() else None, left.slice(0, len(odd))
        told = pa.table({"file": names.column("file"), "split": names.column("split"), "piece": piece[odd], "record": record[odd], "last": offset[odd]})
        sums = pa.table({"file": left.column("file").slice(0, 1), "split": left.column("split").slice(0, 1), "piece": pa.array([None], pa.int64()), "record": pa.array([int(then[seen].max()) if seen.any() else None], pa.int64()), "last": pa.array([last], pa.int64())})
        return pa.concat_tables([told.cast(sums.schema), sums])

    sides = narrow.groupBy("file", "split").cogroup(entries.select(*(F.col(c).alias(c) for c in entries.columns)).groupBy("file", "split"))
    marks = staged(sides.applyInArrow(marked, "file string, split long, piece long, record long, last long"), "marks")
    # One row a split without a piece: its last record and where that one's successor would be.
    ends = marks.where("piece is null").select("file", "split", "last", F.col("record").alias("then"))
    if bad == "raise":
        broken = ends.groupBy("file").agg(F.max("then").alias("then")).join(base.select("file", "file_bytes").distinct(), "file").where("file_bytes > 0 and not (then <=> file_bytes)")
        found = broken.select("file").limit(3).collect()
        if found:
            raise ValueError(f"chains of records break off in {[r.file for r in found]}")
    order = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "split", F.last("last", ignorenulls=True).over(order).alias("carried"), F.last("then", ignorenulls=True).over(order).alias("until"))
    odd = marks.where("piece is not null").alias("marks").join(carried, ["file", "split"], "left")
    earlier = F.when((F.col("record") == -1) & (F.col("marks.last") < F.col("until")), F.col("carried"))
    odd = staged(odd.select("file", "piece", F.when(F.col("record") >= 0, F.col("record")).otherwise(earlier).alias("record")), "odd-pieces")
    whole = pieces.join(odd.select("piece"), "piece", "left_anti")
    parts = pieces.select("piece", "value").join(odd.where("record is not null"), "piece").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("parts"))
    joined = parts.select("file", F.array_join(F.transform("parts", lambda p: p["value"]), magic).alias("value"))
    return whole.select("file", "value").unionByName(joined)


def parsed(records: DataFrame) -> DataFrame:
    """(file, record_type, record_id, page_id, uri, date, payload_digest, refers_to, payload): header fields as they stand, payload null for a revisit."""
    head = F.substring_index("value", END, 1)
    size = F.octet_length(head)
    length = _field(head, "Content-Length").cast("int")
    rows = records.withColumns({"head": head, "block": F.substring(F.col("value").cast("binary"), size + (len(END) + 1), length)})
    http = F.when(F.lower(_field(F.col("head"), "Content-Type")).startswith("application/http"), F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)).otherwise(F.lit(0))
    rows = rows.withColumn("kind", _field(F.col("head"), "WARC-Type")).withColumn("skip", http)
    payload = F.when(F.col("kind") != "revisit", F.substring("block", F.col("skip") + 1, F.octet_length("block")))
    names = {"record_id": "WARC-Record-ID", "page_id": "WARC-Page-ID", "uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
    return rows.select("file", F.col("kind").alias("record_type"), *(_field(F.col("head"), h).alias(c) for c, h in names.items()), payload.alias("payload"))


def read(spark: SparkSession, path: str, magic: str = MAGIC, bad: str = "raise") -> DataFrame:
    """The records of all files under path, as ``parsed`` has them."""
    return parsed(records_of(staged(pieces_of(spark, path, magic), "pieces"), magic, bad))


def payload_facts(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): of each record, of a revisit through the response it names by its page."""
    facts = staged(records.select("record_type", "record_id", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"), F.substring_index("payload_digest", ":", -1).alias("told")), "record-facts")
    checked = F.when(F.col("digest") == F.col("told"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its digest: "), "record_id")))
    own = facts.where("record_type <> 'revisit'").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    named = facts.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("page_id").alias("of"))
    again = facts.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "told").join(named, "refers_to")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("of").alias("refers_to")))


def new_path(spark: SparkSession) -> str:
    """A new folder for files in the cluster's shared folder."""
    return f"{staging_root(spark)}/warc-{uuid.uuid4().hex[:12]}"
