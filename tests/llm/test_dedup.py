"""Duplicate finders, sharding, chat and language id on small tables with nulls, ties and repeated rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import chat_format, embedding_dedup, exact_dedup, language_id, sharding, simhash, substring_dedup

DOCS = "doc_id long, text string, digest int"


def test_exact(spark):
    rows = [(1, "Ab", 0), (2, "aB", 0), (3, None, 0), (4, "", 0), (5, "É", 0), (6, "é", 0), (6, "é", 0), (None, "ab", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = exact_dedup.label_copies(df).collect()
    assert sum(r.kept for r in out) == 4 and len(out) == len(rows)
    assert {(r.keep_id, r.group_size) for r in out} == {(2, 3), (4, 2), (5, 1), (6, 2)}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]
    assert exact_dedup.label_copies(df.limit(0)).count() == 0


def components(n, linked):
    at = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if linked(i, j):
                    at[i] = at[j] = min(at[i], at[j])
    return at


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(6)]
    texts = [*base, *(b + " tail" for b in base), None, "", "one", "Two words", base[0]]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], DOCS)
    fps = [simhash.fingerprint(t) for t in texts]
    want = components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    out = {r.doc_id: r for r in simhash.near_duplicates(df, tile=4).collect()}
    assert [out[k].component_id for k in range(len(texts))] == want
    assert [out[k].fp & (2**64 - 1) for k in range(len(texts))] == fps
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted(set(want))


def plain_fingerprint(text):
    """By the contract's words: A-Z lowered, ASCII blanks, three-word shingles, bits set in over half of them."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", lowered) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = Counter(xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles)
    return sum(1 << b for b in range(64) if 2 * sum(n for h, n in hashes.items() if h >> b & 1) > len(shingles))


def test_fingerprints_by_the_contract(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["A", "bé", "ÀC", "d\x1ce", "\u00a0", "日本"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    texts += [None, "", " \t\x0b\x0c\r\n ", "One", "one TWO", "a  b\tc\nD", "x y z " * 500_000, "w" * 3_000_000]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(2)
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.near_duplicates(df).collect()}
    assert got == {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_first(df.limit(0)).count()


def test_near_copies_with_clashing_ids(spark):
    rng = random.Random(4)
    base, other, third = (" ".join(rng.choice("abcdefghijklmnop") + rng.choice("qrstuv") for _ in range(200)) for _ in range(3))
    assert (plain_fingerprint(base) ^ plain_fingerprint(base + " tail")).bit_count() <= 3
    assert min((plain_fingerprint(x) ^ plain_fingerprint(y)).bit_count() for x, y in ((base, other), (base, third), (other, third))) > 3
    rows = [(5, base, 1), (7, base + " tail", 2), (7, other, 3), (7, other, 4), (None, base, 5), (None, third, 6), (None, third, 7), (None, None, 8), (9, "", 9)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(3))
    assert kept.columns == ["doc_id", "text", "digest"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(5, base), (7, other), (None, third), (9, "")], key=str)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}\n" for k in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 200)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("kind", ["double", "float", "decimal(20,12)"])
def test_embeddings(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 12))
    v[20:30] = v[:10] + 0.05 * rng.normal(size=(10, 12))
    v[30] = v[0]
    v = v.astype(np.float32).astype(np.float64) if kind == "float" else np.round(v, 12)
    rows = [(k, x.tolist(), int(k % 2)) for k, x in enumerate(v)]
    rows += [(40, None, 0), (41, [0.0] * 12, 0), (42, [float("nan")] * 12, 0), (43, v[0].tolist(), None), (44, [], 0), (45, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("embedding", F.expr(f"transform(embedding, x -> try_cast(x as {kind}))"))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = lambda i, j: i != j and i < 40 and j < 40 and i % 2 == j % 2 and u[i] @ u[j] >= 0.98
    want = components(46, linked)
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, tile=8).collect()}
    assert [out[k].component_id for k in range(46)] == want
    assert [out[k].n_links for k in range(46)] == [sum(linked(k, j) for j in range(46)) for k in range(46)]


def test_substrings(spark):
    a = "This passage has more than five words."
    rows = [(1, f"{a} Unique words stand here in a row. As.", 0), (2, f"Other.\n{a.upper()}  As.", 0), (3, None, 0), (4, "", 0), (None, a, 0)]
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), unit="sentence").collect()}
    assert out[1].text == rows[0][1] and out[2].text == "Other.\n  As." and out[3].text is None and out[None].text == ""
    assert [tuple(s) for s in out[2].removed] == [(7, 7 + len(a))]


def test_sharding(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"))
    out = sharding.shard_documents(df, 7, n_slots=500).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 7 and load.max() / load.min() < 1.01
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    slots = sharding.SlotMap.fresh([1] * 500, list(range(1, 501)), 7)
    more = slots.edited(8)
    assert more.version == 2 and max(more.load) / min(more.load) < 1.1
    assert all(b in (a, 7) for a, b in zip(slots.shard, more.shard, strict=True))


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "user", r"<\|end|> <|end|>"), (1, 2, "assistant", "[\\INST] é"), (1, 3, "assistant", None), (2, 0, None, ""), (None, None, "assistant", "<|join|>")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    back = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in back.collect()}
    for c in (1, 2, None):
        own = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].t] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")


def test_language(spark):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5
    model = language_id.fit(spark.createDataFrame([*rows, (None, "en"), ("x", None)], "text string, lang string"))
    df = spark.createDataFrame([(1, "the dogs"), (2, "les chiens"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(df, model).orderBy("doc_id").collect()] == ["en", "fr", "und", "und", "und"]
    empty = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language_id.predict(df, empty).collect()} == {"und"}


def test_repeated_rows_are_spread_over_shards(spark):
    """A third of the rows are one row; nulls and empty texts too; the stored map places unique rows the same."""
    rows = [(-1, "the same row", 0)] * 2000 + [(k, f"text {k}", 0) for k in range(3997)] + [(None, None, 0), (5000, "", 0), (5001, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    path = f"{sharding.staging_root(spark)}/test-map"
    out = sharding.shard_documents(df, 6, map_path=path).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(out) == 6000 and len(load) == 6 and load.max() / load.min() < 1.05
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    slots = sharding.SlotMap.load_from(spark, path, 1)
    assert slots.n_shards == 6 and sum(slots.rows) == 6000
    told = Counter((None if k != k else int(k), v) for k, v in zip(out["doc_id"], out["shard"], strict=True))
    assert len({shard for k, shard in told if k == -1}) == 6
    # The same rows in other files, with other columns: as many of each in each shard, by the query's rule and by assign's.
    odd = df.withColumnRenamed("digest", "shard").withColumn("size", F.lit(1)).repartition(5, "text")
    for _ in range(2):
        placed = sharding.assign(odd, slots)
        assert placed.columns == ["doc_id", "text", "size", "shard"]
        assert Counter((r.doc_id, r.shard) for r in placed.collect()) == told
    again = sharding.shard_documents(odd.coalesce(1), 6)
    assert Counter((r.doc_id, r.shard) for r in again.collect()) == told
    # Sizes and CRCs against zlib.
    known = {(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, _ in rows}
    assert {(None if k != k else int(k), int(n), int(c)) for k, n, c in zip(out["doc_id"], out["size"], out["text_crc32"], strict=True)} == known
    # A stored map is edited for one more shard with newly counted rows, stored, and applied: rows move into the new one only.
    grown = odd.unionByName(spark.createDataFrame([(k, f"new {k}", 0, 0) for k in range(7000, 7400)], "doc_id long, text string, shard int, size int"))
    counted = sharding.count_slots(sharding.records(grown), len(slots.shard))
    more = slots.edited(7, *counted)
    more.save(spark, path)
    stored = sharding.SlotMap.load_from(spark, path, 2)
    assert (stored.shard, stored.rows, stored.size, stored.n_shards) == (more.shard, *counted, 7) and sum(counted[0]) == 6400
    before, after = (sharding.assign(grown, m).groupBy("doc_id", "text", "shard").count().collect() for m in (slots, stored))
    load = Counter()
    for r in after:
        load[r.shard] += r["count"] * (len((r.text or "").encode()) + 8)
    assert max(load.values()) / min(load.values()) < 1.05 and len(load) == 7
    was = {(r.doc_id, r.text, r.shard): r["count"] for r in before}
    assert all(r.shard == 6 or r["count"] <= was.get((r.doc_id, r.text, r.shard), 0) for r in after)
    assert sharding.shard_documents(df.limit(0), 6).count() == 0


def test_turns_sort_by_their_raw_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "<A"), (1, 0, "user", "</s>")], "conv_id int, turn int, role string, text string")
    out = chat_format.format_conversations(df)
    (row,) = out.select(chat_format.read_turns(F.col("formatted")).alias("t")).collect()
    assert [t.text for t in row.t] == sorted(["<A", "</s>"])
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_units_by_name(spark):
    a, b = "One two three four five. Six seven eight nine ten.", "One two three four five. Other words stand here now."
    rows = [(1, f"{a}\n\n{b}\n", 0), (2, f"{a}\nnew line\n\n{b}\n", 0), (3, f"{b}\n", 0)]
    df = spark.createDataFrame(rows, DOCS)
    left = lambda unit: [r.text for r in substring_dedup.remove_repeats(df, unit=unit).orderBy("doc_id").collect()]
    assert left("line") == [rows[0][1], "new line\n\n", ""]
    assert left("paragraph") == [rows[0][1], f"{a}\nnew line\n\n", ""]
    assert left("sentence")[2] == ""
