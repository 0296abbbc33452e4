"""Near words, forms and roots against all pairs of a small table."""

import random
import zlib
from collections import Counter

import pytest

from barwright.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    out = Counter()
    for key, text in rows:
        runs, run = [], ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
            else:
                runs.append(run)
                run = ""
        for r in filter(None, runs):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if key is None else key}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                out[r] += 1
    return {w: n for w, n in out.items() if n >= 2}


def expected(n):
    forms, out = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = [forms[w], w, n[w], len(others), n[best] if forms[w] else None]
    for w in n:
        while forms[out[w][1]]:
            out[w][1] = forms[out[w][1]]
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    bases = ["lettering", "committee", "aaaaaaaa", "straßenbahn", "×÷×÷×÷×÷", "occurrence", "mississippi"]
    words = []
    for b in bases:
        words += [b] * 120
        for _ in range(25):
            i = rng.randrange(len(b))
            v = rng.choice([b[:i] + b[i + 1 :], b[:i] + rng.choice("abÿé") + b[i:], b[:i] + rng.choice("xyÀ") + b[i + 1 :]])
            words += [v] * rng.choice([2, 2, 3, 11, 12])
            words += [v[:-1] + rng.choice("qrs")] * rng.choice([1, 2])
    for chain in (("grandmother", "grandmothr", "grandmohr"), ("neighbourhood", "neighborhood", "neighborhoo")):
        words += [w for w, n in zip(chain, (320, 28, 2), strict=True) for _ in range(n)]
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    rng.shuffle(words)
    out = [(i, rng.choice(" ,.1\n").join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    return [*out, (None, "committee committee"), (5, None), (6, ""), (7, " - 12 "), *[(8, "Repeated repeated")] * 2, (9, "y" * 3000 + " " + "y" * 3000), (10, "y" * 2999 + "z " + "y" * 2999 + "z")]


def test_whole_result_equals_all_pairs(spark, rows):
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, word string, n int, id int")
    want = expected(counted(rows))
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] != v[1] for v in want.values() if v[0])
    assert result(S.variants(docs)) == want


def test_equal_keys_of_different_strings(spark, rows):
    n = counted(rows)
    words = spark.createDataFrame([(i, w, n[w]) for i, w in enumerate(sorted(n)) if len(w) < 100], "id long, word string, n long")
    got = {r["id"]: (r["n_near"], tuple(r["best"])) for r in S.near_words(words, key_bits=3).collect()}
    assert got == {r["id"]: (r["n_near"], tuple(r["best"])) for r in S.near_words(words).collect()}
    assert got


def test_chains_are_followed_to_their_ends(spark, tmp_path):
    from barwright.llm.shared import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(17)] + [(50, 60)], "id long, form long")
    got = {r["id"]: r["last"] for r in S.last_forms(links, Scratch(spark, "test")).collect()}
    assert got == {i: 17 for i in range(17)} | {50: 60}


def test_empty_table_and_bad_ratio(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(docs).count() == 0
    with pytest.raises(ValueError, match="round in circles"):
        S.variants(docs, times=1)
