"""WARC files against a plain parser, with version lines and whole records inside payloads, over few and many splits."""

import base64
import hashlib
import os
import random

import pytest

from quadrille.llm import queries, warc


def plain_records(data):
    """(headers, block) of each record of a file, by its lengths alone."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        head = dict(line.split(": ", 1) for line in lines[1:])
        n = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + n]))
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n
    return out


def files_of(path):
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(f"{path}/{name}", "rb") as f:
                yield f.read()


INSIDE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:0>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages():
    rng = random.Random(3)
    rows = [(k, f"http://x/{k}", "".join(rng.choice("abé \r\n<>") for _ in range(rng.randrange(300)))) for k in range(60)]
    odd = ["", None, INSIDE, INSIDE * 40, "WARC/1.1\r\n", "WARC/1.1\r\n" * 30, "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "\r\n\r\n", "x" + INSIDE[:-2], "WARC/1.", "z" * 5000]
    rows += [(100 + k, f"u{k}", t) for k, t in enumerate(odd)] + [(200 + k, "same", INSIDE) for k in range(30)]
    return rows + [rows[5], (None, None, "no id"), (None, "a\r\nWARC-Type: x", "é" * 9), (-4, "u", rows[7][2]), (7, "other page, same id", "seven")]


def expected(rows, min_bytes=0):
    best, out = {}, []
    data = [(t or "").encode() for _, _, t in rows]
    for n, (k, _, _) in enumerate(rows):
        rank = (-(10**9) if k is None else k, n)
        best[data[n]] = max(best.get(data[n], rank), rank)
    for n, (k, _, _) in enumerate(rows):
        first = best[data[n]]
        again = n != first[1] and len(data[n]) >= min_bytes
        digest = base64.b32encode(hashlib.sha1(data[n]).digest()).decode()
        out.append((k, len(data[n]), digest, "revisit" if again else "response", first[0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split,min_bytes", [(1 << 27, 0), (900, 5)])
def test_there_and_back(spark, tmp_path, split, min_bytes):
    rows, path = pages(), str(tmp_path / "warc")
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, record int, piece int").repartition(3)
    warc.write(df, path, min_bytes=min_bytes)
    plain = [r for data in files_of(path) for r in plain_records(data)]
    assert len(plain) == len(rows)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        records = warc.staged(warc.read(spark, path), "test-records")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    got = sorted(((r.record_id, r.record_type, r.page_id, r.uri, r.refers_to, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in records.collect()), key=str)
    block = lambda h, b: None if h["WARC-Type"] == "revisit" else b.split(b"\r\n\r\n", 1)[1]
    assert got == sorted(((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Page-ID"), h.get("WARC-Target-URI"), h.get("WARC-Refers-To"), h["WARC-Payload-Digest"], block(h, b)) for h, b in plain), key=str)
    number = lambda x: None if x is None else int(x)
    facts = [(number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in warc.payload_facts(records).collect()]
    want = expected(rows, min_bytes)
    # Of repeated rows any may be the response.
    assert sorted(facts, key=str) == want


def test_bytes_that_are_no_text(spark, tmp_path):
    data = [bytes(range(256)), b"\xff\xfe", b"\r\n\r\n\x00WARC/1.1\r\n\xff", b""]
    warc.write(spark.createDataFrame([(k, "u", x) for k, x in enumerate(data)], "page_id int, url string, html binary"), str(tmp_path / "w"))
    assert {int(r.page_id): bytes(r.payload) for r in warc.read(spark, str(tmp_path / "w")).collect()} == dict(enumerate(data))


def test_damaged_files(spark, tmp_path):
    path = tmp_path / "w"
    warc.write(spark.createDataFrame([(k, "u", f"page {k} {INSIDE}") for k in range(9)], "page_id int, url string, html string").coalesce(1), str(path))
    (name,) = [n for n in os.listdir(path) if n.startswith("part-")]
    data = (path / name).read_bytes()
    os.remove(path / f".{name}.crc")
    for cut, left in ((len(data) - 2, 8), (data.index(b"page 5"), 5), (3, 0)):
        (path / name).write_bytes(data[:cut])
        with pytest.raises(ValueError):
            warc.read(spark, str(path))
        assert sorted(int(r.page_id) for r in warc.read(spark, str(path), bad="keep").collect()) == list(range(left))
    with pytest.raises(ValueError):
        warc.read(spark, str(path), bad="skip")


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id int, url string, html string"), str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"))
    assert records.count() == 0 and warc.payload_facts(records).count() == 0


def test_query_reads_what_it_wrote(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = queries.op12_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows)
