"""Kneser-Ney models against the formulas, and held-out accuracy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import language

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_probabilities_equal_the_formulas():
    rng = np.random.default_rng(1)
    alphabet = language.Alphabet(np.array([ord(c) for c in "abcd"]))
    texts = ["".join(rng.choice(list("aabcd  "), 60)) for _ in range(30)]
    keys, _, _ = language.encode(texts, alphabet)
    grams, counts = np.unique(keys, return_counts=True)
    model = language.KneserNey(grams, counts, alphabet.size)
    mask = (1 << language.BITS) - 1
    as_tuple = lambda k: tuple((k >> (language.BITS * j)) & mask for j in reversed(range(language.ORDER)))
    level = Counter({as_tuple(int(g)): int(n) for g, n in zip(grams, counts, strict=True)})
    levels = [level]
    for _ in range(language.ORDER - 1):
        level = Counter(g[1:] for g in level)
        levels.append(level)

    def p(gram):
        if not gram:
            return 1 / alphabet.size
        c = levels[language.ORDER - len(gram)]
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        same = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * p(gram[1:])

    some = np.concatenate([rng.choice(grams, 40), np.array([int(g) ^ 3 for g in rng.choice(grams, 20)])])
    assert np.allclose(2 ** model.log2(some), [p(as_tuple(int(g))) for g in some], rtol=1e-4)
    contexts = {as_tuple(int(g))[:-1] for g in grams[:30]}
    for c in contexts:
        assert sum(p((*c, x)) for x in range(alphabet.size)) == pytest.approx(1, abs=1e-9)


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(DATA)
    odd = [(100_000, "зжщ жщз бвгд " * 80, None, None, None), (100_001, None, "en", None, None), (100_002, "12 34 --", "en", None, None), (None, "x", None, None, None)]
    return {r.doc_id: r for r in language.identify(docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("x"))).collect()}


def test_held_out_accuracy(judged):
    of = [r for r in judged.values() if r.held_out and r.lang and r.text and any(c.isalpha() for c in r.text)]
    assert len(of) > 100 and np.mean([r.lang_pred == r.lang for r in of]) > 0.95
    assert all(0 <= r.score <= 1 for r in judged.values())


def test_rejection(judged):
    assert judged[100_000].rejected and judged[100_001].rejected and judged[100_002].rejected
    assert judged[100_001].lang_pred == judged[100_002].lang_pred == "und" and judged[100_001].score == 0
    usual = [r for r in judged.values() if r.lang and r.text and len(r.text) > 100]
    assert np.mean([r.rejected for r in usual]) < 0.01


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs).collect()] == [("und", 0.0)] * 2
    assert language.identify(docs.where("false")).count() == 0 and language.accepted(docs).count() == 0


def test_short_texts_of_languages_not_learnt(spark):
    docs = spark.read.parquet(DATA)
    wrong = F.when(F.col("doc_id") % 29 == 3, F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang"))
    for rows in (docs, docs.withColumn("lang", wrong)):
        detector = language.fit(rows)
        short = ["szybki brązowy lis przeskakuje nad leniwym psem", "zażółć gęślą jaźń każdego dnia rano", "зжщ жщз бвгд " * 5]
        assert detector.predict(short)[2].all()
        usual = [r.text[len(r.text) // 3 :][:80] for r in docs.where("lang is not null and length(text) > 300").where(language._held_out()).collect()]
        assert len(usual) > 100 and detector.predict(usual)[2].mean() < 0.01


@pytest.mark.parametrize("out", ["es", "de"])
def test_a_language_left_out_is_rejected_and_the_others_are_not(spark, out):
    docs = spark.read.parquet(DATA.replace("sf0.01", "sf0.1"))
    detector = language.fit(docs.where(F.col("lang") != out))
    held = [(r.lang, r.text) for r in docs.where("lang is not null and length(text) > 400").where(language._held_out()).collect()]
    strange = lambda cut: detector.predict([cut(t) for x, t in held if x == out])[2].mean()
    usual = lambda cut: detector.predict([cut(t) for x, t in held if x != out])[2].mean()
    whole, middle = (lambda t: t), (lambda t: t[len(t) // 3 :][:200])
    assert strange(whole) > 0.95 and strange(middle) > 0.85
    for n in (20, 50, 100, 200):
        assert usual(lambda t: t[len(t) // 3 :][:n]) < 0.005  # noqa: B023
    assert usual(whole) < 0.005


def test_ties_long_texts_and_few_calibration_rows(spark):
    rows = [(i, "same words again", lang) for i in range(200) for lang in ("b", "a")] + [(1000, "same words " * 200_000, None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"a"} and len(got) == len(rows)
    few = [(i, f"some text {i} that is short", "en") for i in range(9)] + [(99, "зжщ жщз", None)]
    assert not any(r.rejected for r in language.identify(spark.createDataFrame(few, "doc_id long, text string, lang string")).collect())


def test_letters_of_any_script_have_symbols(spark):
    rows = [(i, t * 9, x) for i in range(120) for x, t in (("zh", "我们今天去学校学习新的知识 "), ("ja", "私たちは今日学校へ行きます "), ("ko", "우리는 오늘 학교에 갑니다 "))]
    docs = spark.createDataFrame([(3 * i + k, t, x) for k, (i, t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in language.identify(docs).collect())
