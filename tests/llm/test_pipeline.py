"""The pipeline on a small table, each stage held against a plain Python version of it."""

import random
import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from quadrille.llm import simhash, substring_dedup
from quadrille.llm.queries import tokenizer_path


def plain(docs):
    docs = {k: t for k, t in docs.items() if t and any(c.isalpha() for c in t)}
    last = {}
    for k in sorted(docs):
        last["".join(c.lower() if c.isascii() else c for c in docs[k])] = k
    docs = {k: docs[k] for k in last.values()}
    fps, root = {k: simhash.fingerprint(t) for k, t in docs.items()}, {k: k for k in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    docs, seen = {k: docs[k] for k in sorted(docs) if root[k] == k}, set()
    for k, t in docs.items():
        spans = []
        for a, b, d in substring_dedup.units_of(t, unit="sentence"):
            if d in seen:
                spans.append((a, b))
            seen.add(d)
        docs[k] = substring_dedup.cut_out(t, spans)
    return docs


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["the", "dog", "runs", "far", "and", "a", "cat", "sleeps", "well"]) for _ in range(rng.randrange(6, 30))) + "."
    texts = [" ".join(sentence() for _ in range(rng.randrange(2, 9))) for _ in range(12)]
    shared = sentence()
    texts += [texts[0].upper(), texts[1] + " x", f"{sentence()} {shared} {sentence()}", f"{shared} {sentence()}", None, "", "123 !", "word " * 5000]
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    want, library = plain(dict(enumerate(texts))), Tokenizer.from_file(tokenizer_path())
    assert len(want) < len(texts) - 4
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert {r.doc_id: r.text for r in docs.collect()} == want
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(want)
    for k, own in pieces.items():
        ids = np.array([*library.encode(want[k], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for start, length, crc in sorted(own):
            assert start == at and zlib.crc32(ids[at : at + length].tobytes()) == crc
            at += length
        assert at == len(ids)
