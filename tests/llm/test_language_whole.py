"""Language id: whole words, letters, a plain version, held-out accuracy."""

import math
import random
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import language_id

SF = Path("/root/testdata/sf0.01/documents.parquet")


def plain_words(text):
    """Character by character: a letter, then letters and marks."""
    out, word = [], ""
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        else:
            out.append(word)
            word = ""
    return Counter(x for x in [*out, word] if x)


def plain_scores(rows, text):
    """Mean log score by language, from the definitions, without tables."""
    langs = sorted({lang for t, lang in rows if plain_words(t)})
    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, lang in rows:
        for w, n in plain_words(t).items():
            words[lang][w] += n
            p = f"^{w}$"
            for size in (1, 2, 3, 4):
                for at in range(len(p) - size + 1):
                    grams[lang][p[at : at + size]] += n
    every_word, every_gram = set().union(*words.values()), set().union(*grams.values())
    log = lambda counts, key, size: math.log((counts[key] + 0.5) / (sum(counts.values()) + 0.5 * (size + 1)))
    total, number = dict.fromkeys(langs, 0.0), 0.0
    for w, n in plain_words(text).items():
        weight = n * max(1, len(w) / 64) if len(w) > 64 else n
        number += weight
        for lang in langs:
            if w in every_word:
                total[lang] += weight * log(words[lang], w, len(every_word))
            else:
                p = f"^{w}$"
                for at in range(len(w) + 1):
                    size = next((s for s in (4, 3, 2, 1) if p[at : at + s] in every_gram), 0)
                    if size:
                        total[lang] += weight / (len(w) + 1) * log(grams[lang], p[at : at + size], len(every_gram))
    return {x: y / number for x, y in total.items()} if number else {}


def test_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    rows = [(" ".join(word(letters) for _ in range(30)), lang) for letters, lang in (("abcdeé", "aa"), ("defghß", "bb"), ("хцчшщ", "cc")) for _ in range(4)]
    model = language_id.fit(spark.createDataFrame([*rows, (None, "aa"), ("no label", None), ("12 ½", "dd")], "text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    texts = ["".join(rng.choice("abcdefghéßхцч  .,1½") for _ in range(rng.randrange(1, 400))) for _ in range(40)] + [rows[0][0], "d" * 2000, "dé " * 500 + "q" * 300]
    for piece, places in ((1 << 20, 1024), (17, 5)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "PLACES", places)
        for t in texts:
            want = plain_scores(rows, t)
            if not want:
                assert model.predict(t) == ("und", 0.0)
                continue
            total, n = model.scores(t)
            assert np.allclose(total / n, [want[x] for x in model.langs])
            lang, score = model.predict(t)
            assert want[lang] >= max(want.values()) - 1e-9 and 0 < score <= 1


def test_words_are_the_same_for_training_and_prediction():
    for t in ["½ ² ① Ⅷ", "a½b", "हिन्दी भाषा में", "e\u0301te\u0301", "\u0301a", "x" * 3000 + "1y", "𝐀𝐁 𐐷x", "ʼaʼ", "日本 語", "A_B9c", "İstanbul", ""]:
        assert language_id.words_of(t) == plain_words(t), t
    assert list(language_id.words_of("हिन्दी")) == ["हिन्दी"]


def test_no_cut_in_long_words(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 10)
    text = "abcdefghijk\u0301\u0301l mno " * 9 + "z" * 50
    assert language_id.words_of(text) == plain_words(text)


def test_undetermined(spark):
    model = language_id.fit(spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string"))
    for t in ("½ ²", "①", "Ⅷ", "12 !", "", None, "\u0301", "_", "😀"):
        assert model.predict(t) == ("und", 0.0), t
    assert model.predict("é")[0] in ("en", "fr") and model.predict("②the")[0] == "en"


def test_ties_repeats_clashes_long(spark):
    rows = [("same words", "bb"), ("same words", "aa")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([(1, "same", "x", 5), (1, "same", "x", 5), (2, "words " * 400_000, "y", 6), (3, "w" * 2000, None, 7)], "doc_id long, text string, lang_pred string, score int")
    out = language_id.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert {r[1] for r in got} == {"aa"} and got[0] == got[1] and len(got) == 4
    kept = language_id.predict(df, model, lang_out="l", score_out="s")
    assert kept.columns == [*df.columns, "l", "s"] and kept.limit(0).count() == 0


def test_words_beyond_64_characters_are_read_whole(spark):
    rng = random.Random(7)
    word = lambda letters, size: "".join(rng.choice(letters) for _ in range(size))
    rows = [(word("klmno", 64) + word(x, 2000), lang) for _ in range(3) for x, lang in (("abcde", "aa"), ("vwxyz", "bb"))]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    a, b = word("klmno", 64) + word("abcde", 2000), word("klmno", 64) + word("vwxyz", 2000)
    assert [model.predict(a)[0], model.predict(b)[0]] == ["aa", "bb"]
    assert model.scores(f"{a} ab")[1] == len(a) / 64 + 1


def test_rare_languages_are_sampled(spark):
    rows = [(k, f"the dog number {k % 7} runs", "en") for k in range(3000)] + [(3000 + k, "le chien court vite", "fr") for k in range(3)]
    df = spark.createDataFrame([*rows, (4000, "123", "xx")], "doc_id long, text string, lang string")
    model = language_id.fit(df, max_rows=60)
    assert model.langs == ["en", "fr"] and model.predict("le chien court")[0] == "fr" and model.predict("the dog runs")[0] == "en"


def test_copies_and_long_texts_keep_to_the_bounds(spark):
    df = spark.createDataFrame([(k, "the same text", "en" if k % 2 else "fr") for k in range(4000)], "doc_id long, text string, lang string")
    n = dict(language_id.sampled(df, max_rows=400).groupBy("lang").count().collect())
    assert n.keys() == {"en", "fr"} and all(130 < x < 270 for x in n.values())
    n = dict(language_id.sampled(df, max_chars=4000).groupBy("lang").count().collect())
    assert all(100 < x < 220 for x in n.values())


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(SF))
    model = language_id.fit(docs.where(~language_id.held_out()))
    told = language_id.predict(docs, model).where(language_id.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    right, n = told.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right / n >= 0.99
