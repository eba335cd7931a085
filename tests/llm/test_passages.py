"""Repeated passages in the pipeline's dedup stage, found by plain word windows."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def cut(spark, texts):
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    return [r.text for r in corpus_pipeline.without_repeated_passages(spark, df, "").orderBy("doc_id").collect()]


def again(texts, size, blanks=True):
    seen, n = set(), 0
    for t in texts:
        words = t.lower().split() if blanks else t
        own = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        n += len(own & seen)
        seen |= own
    return n


def test_run_without_sentence_end(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    shared = [words(n) for n in (50, 51, 60, 90, 200)]
    texts = [f"{words(30)} {s} {words(30)}" for s in shared for _ in range(3)]
    out = cut(spark, texts)
    assert again(texts, 50) > 0 and again(out, 50) == 0
    assert out[::3] == texts[::3] and all(a.split()[:30] == b.split()[:30] and a.split()[-30:] == b.split()[-30:] for a, b in zip(out, texts, strict=True))


def test_short_sentences_inside(spark):
    a, b = "One long sentence stands at the front.", "Another long sentence ends it all here."
    out = cut(spark, [f"{a} Oh yes. {b} First.", f"Second. {a} Oh yes. {b} Third.", f"{a} Oh no. {b}"])
    assert "Oh yes" in out[0] and out[1].split() == ["Second.", "Third."] and out[2].split() == ["Oh", "no."]


def test_text_without_blanks(spark):
    rng = random.Random(5)
    chars = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = chars(120)
    texts = [chars(20) + shared + chars(20), chars(33) + shared + chars(9), "早上好今天。" + chars(8), chars(7) + "。早上好今天。"]
    out = cut(spark, texts)
    assert again(out, 50, False) == 0 and out[0] == texts[0] and "早上好今天" not in out[3]
