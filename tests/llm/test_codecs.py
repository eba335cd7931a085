"""BPE against the tokenizers library, token files and packing by round trip."""

import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import bpe, packing, token_output
from quadrille.llm.queries import tokenizer_path

PATH = tokenizer_path()
ODD = ["", "<|endoftext|>", "a<|endoftext|> b", "a  b\n\n c\xa0 d e", "it'll 've", "x" * 5000, "thé " * 900, "中文字😀\x00\x1c", " lead", "trail ", "\n"]


@pytest.fixture(scope="module")
def pair():
    return bpe.Codec(PATH), Tokenizer.from_file(PATH)


def check(pair, text):
    codec, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == ids, text
    assert codec.decode(np.array(ids, dtype=np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_same_ids(pair, monkeypatch):
    rng = random.Random(3)
    for text in ODD:
        check(pair, text)
    for _ in range(3000):
        check(pair, "".join(rng.choice([" ", "  ", "\n", "'ll", "the", "é", "9", "\xa0 ", chr(rng.randrange(1, 0x3000)), chr(rng.randrange(0x10000, 0x1FFFF))]) for _ in range(rng.randrange(12))))
    monkeypatch.setattr(bpe, "PART_BYTES", 50)
    for text in ("some words, and more.\n" * 40, "".join(ODD), "<|endoftext|>" * 30 + " x" * 90, "x" * 400, "中文" * 100):
        check(pair, text)


def test_cuts_are_certain(pair):
    """Fragments encoded one by one by the library have the ids of the whole."""
    codec, library = pair
    text = "It's  a 'quoted'\tline,\n\n with\xa0space – and don't, naïve 東京、x!!'s\r\n  end "
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    cuts = [0, *codec.cut_places(data).tolist(), len(data)]
    parts = [data[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert len(parts) > 20
    assert [k for x in parts for k in library.encode(x, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_library_merges_where_ranks_do_not_tell(pair, monkeypatch):
    """A file with a token that does not encode to itself is left to the library's merges."""
    codec, library = pair
    monkeypatch.setattr(codec, "ranked", None)
    monkeypatch.setattr(codec, "known", {})
    for text in ODD:
        check(pair, text)


def test_tokens_encode_to_themselves(pair):
    codec = pair[0]
    assert all(np.frombuffer(codec._fragment(t), dtype=np.int32).tolist() == [k] for k, t in enumerate(codec.bytes_of) if k not in codec.added.values())


def test_encode_frame(spark):
    rows = [(k, t, 1) for k, t in enumerate([*ODD, None, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {r.doc_id: r for r in bpe.round_trip(df, PATH).collect()}
    assert all(out[k].decoded == (t or "") for k, t, _ in rows)
    both = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in both)
    assert bpe.encode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("ids", [[7], [0] * 700, list(range(0, 50257, 61)), [1, 2, 3] * 300, [50256] * 300])
def test_stripes(ids):
    data = token_output.write_stripe(np.array(ids), 128)
    assert token_output.read_stripe(data).tolist() == ids
    spoilt = bytearray(data)
    spoilt[24] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_output.read_stripe(bytes(spoilt))


@pytest.mark.parametrize("block", [100, 5000, token_output.BLOCK])
def test_stripes_of_any_shape(block):
    """Even, skewed, repeating and extreme ids; lanes that share a model, blocks of their own, carries."""
    rng = np.random.default_rng(5)
    for n in (1, 255, 257, 20_000):
        for ids in (rng.integers(0, 1 << 16, n), rng.zipf(1.3, n) % 50_257, np.full(n, 65_535), np.arange(n) % 7, np.repeat(rng.integers(0, 9, n), 3)):
            data = token_output.write_stripe(ids, block)
            assert (token_output.read_stripe(data) == ids).all()
    assert len(token_output.write_stripe(np.full(20_000, 9))) < 4_000


def uneven_blocks():
    i = np.arange(40_000)
    return [i[:16384] * 7919 % 9973 % 311, i[16384:32768] * i[16384:32768] // 97 % 9001, i[32768:] // 5 % 700], [311, 9001, 700]


def test_words_of_the_format():
    """The same ids give the same words, whatever the code that makes them."""
    lanes, words = token_output.encode_blocks(*uneven_blocks())
    assert lanes == 192 and [(len(x), zlib.crc32(x)) for x in words] == [(5744, 3015334101), (28428, 903567749), (4518, 1423476846)]


def test_a_step_makes_few_calls():
    """Calls of functions of numpy for a step of all lanes; 106 and 98 when each named id had a table of its own."""
    blocks, widths = uneven_blocks()
    lanes, words = token_output.encode_blocks(blocks, widths)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    def run(work, *args):
        nonlocal calls
        calls = 0
        sys.setprofile(count)
        try:
            return work(*args)
        finally:
            sys.setprofile(None)

    steps = -(-16384 // lanes)
    run(token_output.encode_blocks, blocks, widths)
    assert calls < 85 * steps
    got = run(token_output.decode_blocks, words, lanes, 16384, [len(x) for x in blocks], widths)
    assert calls < 90 * steps
    assert all((a == b).all() for a, b in zip(got, blocks, strict=True))


def test_lanes_with_more_words_than_room():
    """Rows of words grow, and carries and the order of words go on over that."""
    rng = np.random.default_rng(7)
    start, share = rng.integers(0, (1 << 26) - 9, (60, 6)), rng.integers(1, 9, (60, 6))
    told = []
    for room in (1, 3, 1000):
        out = token_output._Writer(6, room)
        for a, b in zip(start, share, strict=True):
            out.put(a, b)
        told.append(out.finish(2))
    assert told[0] == told[1] == told[2]
    source = token_output._Reader(told[0], 3)
    for a, b in zip(start, share, strict=True):
        place = source.place()
        assert ((a <= place) & (place < a + b)).all()
        source.take(a, b)


def test_a_spoilt_block_costs_itself_only():
    rng = np.random.default_rng(6)
    ids = rng.zipf(1.3, 3500) % 5000
    data = token_output.write_stripe(ids, 1000)
    sizes = np.frombuffer(data[12 : 12 + 20 * 4], dtype="<u4").reshape(4, 5)[:, 2:4].sum(axis=1)
    for block in range(4):
        spoilt = bytearray(data)
        at = 92 + int(sizes[:block].sum())
        for k in range(at + 300, at + 340):
            spoilt[k] ^= 255
        found = token_output.read_blocks(bytes(spoilt))
        assert [x is None for _, x in found] == [k == block for k in range(4)]
        assert all((x == ids[1000 * k : 1000 * k + n]).all() for k, (n, x) in enumerate(found) if x is not None)


def test_the_block_table_is_checked():
    data = token_output.write_stripe(np.arange(300) % 50, 100)
    for at in range(4, 12 + 20 * 3):
        spoilt = bytearray(data)
        spoilt[at] ^= 1
        with pytest.raises(ValueError, match="table"):
            token_output.read_blocks(bytes(spoilt))


def test_spoilt_bodies_raise():
    """A wrong byte in a body raises ValueError, unless it changes no id."""
    rng = np.random.default_rng(6)
    data = token_output.write_stripe(rng.zipf(1.3, 3000) % 5000, 1000)
    for at in rng.integers(12 + 20 * 3, len(data), 150):
        spoilt = bytearray(data)
        spoilt[at] ^= int(rng.integers(1, 256))
        try:
            same = token_output.read_stripe(bytes(spoilt)).tolist() == token_output.read_stripe(data).tolist()
        except ValueError:
            continue
        assert same  # the last words of a lane have bits that decide nothing


def test_ids_out_of_bounds():
    for ids in ([-1], [1 << 16]):
        with pytest.raises(ValueError, match="ids must be"):
            token_output.write_stripe(np.array(ids))


def test_token_files(spark):
    texts = [*ODD, None, "same", "same"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    path = token_output.new_path(spark)
    token_output.write(df, path, PATH, block=256, stripe_ids=2000)
    library, at = Tokenizer.from_file(PATH), 0
    for r in token_output.read(spark, path).orderBy("id").collect():
        want = [*library.encode(texts[r.id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.ids) == (at, want)
        at += len(want)


def test_token_checks(spark):
    """The checks that op9 returns, with null, equal and odd ids, an empty table, and a block that is lost."""
    texts = ["one text", "two", None, "", "same id", "same id too", "x" * 3000, "a null id"]
    ids = [5, 3, 9, 1, 7, 7, 8, None]
    library = Tokenizer.from_file(PATH)
    want = {t: [*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts}
    for kind in ("long", "string", "decimal(9,2)"):
        df = spark.createDataFrame([(k, t, 1) for k, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int").withColumn("doc_id", F.col("doc_id").cast(kind))
        path = token_output.new_path(spark)
        token_output.write(df.repartition(3), path, PATH, block=128, stripe_ids=500)
        got = token_output.read_checks(spark, path).orderBy("start").collect()
        assert [None if r.id is None else float(r.id) for r in got] == [None, 1, 3, 5, 7, 7, 8, 9]
        at = 0
        for r in got:
            assert r.start == at
            at += r.ids.n
        crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
        assert sorted((r.ids.n, r.ids.crc32) for r in got) == sorted((len(x), crc(x)) for x in want.values())
        empty = token_output.new_path(spark)
        token_output.write(df.limit(0), empty, PATH)
        assert token_output.read_checks(spark, empty).count() == 0
    row = spark.read.parquet(path).orderBy(F.desc("n_ids")).first()
    data = bytearray(row.data)
    data[12 + 20 * data[4] + 3] ^= 255  # in the first block's alphabet
    broken = token_output.new_path(spark)
    spark.createDataFrame([row.asDict() | {"data": bytes(data)}], spark.read.parquet(path).schema).write.parquet(broken)
    lost = {r.id: r.ids for r in token_output.read_checks(spark, broken, bad="null").collect()}
    assert None in lost.values() and len(lost) == len(set(row.ids))
    with pytest.raises(Exception, match="checksum"):
        token_output.read_checks(spark, broken).collect()


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def bins_of(out, sizes, capacity):
    """How many bins; every piece is in one place, places are gapless, no bin is too full."""
    assert sorted(r.key for r in out) == sorted(sizes)
    bins = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert r.offset == bins.get(r.bin, 0)
        bins[r.bin] = r.offset + sizes[r.key]
    assert max(bins.values()) <= capacity
    return len(bins)


def test_pack(spark):
    rng = random.Random(5)
    sizes = {k: rng.randrange(1, 100) for k in range(600)}
    items = spark.createDataFrame(list(sizes.items()), "key long, length long")
    for block in (200, 10_000):
        assert bins_of(packing.pack(items, 100, block=block).collect(), sizes, 100) <= packing.lower_bound(list(sizes.values()), 100) * 1.03 + 3
    assert packing.pack(items.limit(0), 100).count() == 0


def test_blocks_meet_again(spark):
    """Forty blocks, each with a part-filled sequence, end with about as few as one block."""
    rng = random.Random(6)
    sizes = {k: rng.randrange(5, 60) for k in range(1600)}
    items = spark.createDataFrame(list(sizes.items()), "key long, length long")
    assert bins_of(packing.pack(items, 100, block=40).collect(), sizes, 100) <= packing.lower_bound(list(sizes.values()), 100) * 1.02


def test_evolution_betters_best_fit():
    """Sets on which best fit, decreasing or not, wastes sequences, and crossover finds better ones."""
    rng = np.random.default_rng(7)
    triplets = [x for _ in range(200) for a in [int(rng.integers(380, 490))] for b in [int(rng.integers(250, (1000 - a) // 2 + 1))] for x in (a, b, 1000 - a - b)]
    for sizes, capacity in (([4, 4, 3, 3, 3, 3] * 100, 10), (triplets, 1000), (rng.integers(150, 700, 600).tolist(), 2048)):
        decreasing = packing.best_fit(sizes, capacity, np.argsort(-np.array(sizes), kind="stable"))
        first = packing.founders(sizes, capacity, np.random.default_rng(1), 6)
        began = min(len(p.bins) for p in first)
        found = packing.evolve(first, sizes, capacity, np.random.default_rng(2), 20)[0]
        assert packing.lower_bound(sizes, capacity) <= len(found.bins) < min(began, len(decreasing.bins))


def test_never_above_best_fit_decreasing():
    """8,192 sizes as a block has them, evenly spread ones among them, with the settings of the query."""
    rng = np.random.default_rng(8)
    for sizes in (rng.integers(1, 2047, 8192), np.clip(rng.lognormal(6, 1, 8192), 1, 2047).astype(int), rng.integers(500, 1400, 8192)):
        sizes = sizes.tolist()
        decreasing = len(packing.best_fit(sizes, 2048, np.argsort(-np.array(sizes), kind="stable")).bins)
        first = packing.founders(sizes, 2048, np.random.default_rng(1), packing.POPULATION)
        found = packing.evolve(first, sizes, 2048, np.random.default_rng(2), packing.GENERATIONS)[0]
        assert packing.lower_bound(sizes, 2048) <= len(found.bins) <= decreasing and sorted(i for b in found.bins for i in b) == list(range(8192))


def fewest(sizes, capacity):
    """Brute force: the fewest bins, piece by piece into every bin that takes it."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[k] and rooms[j] not in rooms[:j]:
                go(k + 1, [*rooms[:j], rooms[j] - sizes[k], *rooms[j + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_small_sets_are_packed_as_well_as_can_be():
    rng = random.Random(4)
    for case in range(60):
        sizes = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 10))]
        best = fewest(sizes, 20)
        assert packing.lower_bound(sizes, 20) <= best
        found = packing.evolve(packing.founders(sizes, 20, np.random.default_rng(case), 6), sizes, 20, np.random.default_rng(case), 8)[0]
        assert len(found.bins) == best


def test_pack_documents(spark):
    """Null, empty, equal and very long texts, equal and null ids, extra columns: places against the library's ids."""
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "same", "same", "a b c " * 4000, *(f"text number {k} " * (k % 90) for k in range(300)), "null id"]
    rows = [(None if t == "null id" else min(k, 299), t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    out = packing.pack_documents(df, PATH).collect()
    want = {}
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, (at, n) in enumerate(packing.cut(len(ids), 2048)):
            k = (i, p, at, n, zlib.crc32(ids[at : at + n].tobytes()))
            want[k] = want.get(k, 0) + 1
    got, places = {}, {}
    for r in out:
        k = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[k] = got.get(k, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    some = df.where("offset between 5 and 60")
    packed = packing.pack_documents(some, PATH)
    whole = {r.sequence_id: r for r in packing.sequences(some, packed, PATH).collect()}
    assert all(sum(r.lengths) == len(r.ids) for r in whole.values()) and sum(len(r.ids) for r in whole.values()) == sum(r.length for r in packed.collect())
