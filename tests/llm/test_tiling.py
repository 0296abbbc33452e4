"""Greedy string tiling against a brute-force version."""

import re
import time

import numpy as np

from barwright.llm import tiling, words


def brute_tiles(doc, item, k):
    """The longest common run of unmarked words, again and again; first in doc, then in item."""
    d, i, out = list(doc), list(item), []
    md, mi = [False] * len(d), [False] * len(i)
    while True:
        best = (0, 0, 0)
        for a in range(len(d)):
            for b in range(len(i)):
                n = 0
                while a + n < len(d) and b + n < len(i) and d[a + n] == i[b + n] and not md[a + n] and not mi[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return out
        out.append((a, b, n))
        md[a : a + n] = [True] * n
        mi[b : b + n] = [True] * n


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(150):
        k = int(rng.integers(1, 5))
        item = rng.integers(0, int(rng.integers(2, 7)), int(rng.integers(3, 40)))
        doc = rng.integers(0, 6, int(rng.integers(3, 40)))
        got = tiling.tiles(words.mix(doc.astype(np.uint64)), words.mix(item.astype(np.uint64)), k)
        assert got == brute_tiles(doc.tolist(), item.tolist(), k)


def test_coverage_of_documents(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(10, 40))))) for i in range(12)]
    items += [(20, "W7 w8 w9 w10"), (21, "alone"), (22, "again " * 30), (23, "two words"), (20, "w1 w2")]
    rows = []
    for i in range(60):
        parts = list(rng.choice(vocab, int(rng.integers(0, 50))))
        if i % 3:
            words = items[int(rng.integers(12))][1].split()
            cut = int(rng.integers(3, len(words) - 3))
            if i % 3 == 2:
                words = words[cut:] + words[:cut]
            parts[len(parts) // 2 : len(parts) // 2] = words[: int(rng.integers(5, len(words) + 1))]
        rows.append((i, "  ".join(parts).upper() if i % 2 else " ".join(parts)))
    rows += [(None, items[0][1]), (60, None), (61, ""), (7, rows[7][1]), (62, "x w7 W8 w9  w10 y"), (63, "w7 w8 w9 x w10"), (64, "again again " * 40), (65, "Alone"), (66, "the two words w1 w2"), (67, "a b again again again again again c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as coverage", "'a' as tiles")
    bench = spark.createDataFrame([*items, items[3], (None, "x y z a b c"), (99, None), (98, " ")], "item_id long, text string")
    for filter_bits in (28, 7):  # the small one lets most seeds pass
        got = tiling.coverage(docs, bench, tiling.Settings(filter_bits=filter_bits)).collect()
        assert len(got) == len(rows)
        want = []
        for i, t in rows:
            best = (None, 0.0, 0)
            n = 0
            for j, u in items:
                found = brute_tiles(split(t), split(u), min(5, len(split(u))))
                c = sum(x[2] for x in found) / len(split(u))
                n += c >= 0.75
                if found and (best[0] is None or (-c, j) < (-best[1], best[0])):
                    best = (j, c, len(found))
            want.append((i, *best, n))
        assert sorted(map(str, ((r.doc_id, r.item_id, r.coverage, r.n_tiles, r.n_items) for r in got))) == sorted(map(str, want))


def test_repeated_words_take_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        same = np.full(n, 7, np.uint64)
        period = words.mix((np.arange(n) % 3).astype(np.uint64))
        began = time.perf_counter()
        assert tiling.tiles(same, same, 5) == [(0, 0, n)]
        assert tiling.tiles(same, same[: n // 7], 5) == [(0, 0, n // 7)]
        assert tiling.tiles(period, period[1 : n // 2], 5) == [(1, 0, n // 2 - 1)]
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert tiling.coverage(docs, bench).count() == 0
    assert tiling.decontaminate(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), bench).count() == 1


def test_a_phrase_that_all_items_and_documents_share(spark):
    """Only one pair of a document needs tiling unless a bound says more; all answers are those of tiling every pair."""
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    phrase = "please answer the following question in detail"
    items = [(i % 38, f"{phrase} {some(20 + i % 3)}") for i in range(40)] + [(90, "two words"), (91, phrase)]
    texts = [f"{some(60)} {phrase} {some(30)}" for _ in range(40)]
    texts += [f"{some(9)} {items[i][1]} {some(9)} {items[i + 1][1]}" for i in range(5)] + [f"{some(3)} two words", "two", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for settings in (tiling.Settings(), tiling.Settings(least_words=3)):
        got = {r.doc_id: (r.item_id, r.coverage, r.n_items) for r in tiling.coverage(docs, bench, settings).collect()}
        hashed = lambda t: np.array([hash(w) % 2**61 for w in t.split()], np.uint64)
        for i, t in enumerate(texts):
            found = []
            for item_id, x in items:
                w = hashed(x)
                if len(w) >= settings.least_words:
                    share = sum(n for _, _, n in tiling.tiles(hashed(t or ""), w, min(5, len(w)))) / len(w)
                    found.append((-share, item_id))
            best = min(found)
            assert got[i][1:] == (-best[0], sum(-s >= 0.75 for s, _ in found))
            assert got[i][0] == (best[1] if best[0] else None)
