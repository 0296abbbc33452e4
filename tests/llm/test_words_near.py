"""Near-duplicate groups against brute force."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from barwright.llm import near_dedup, words


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def test_sets_have_the_sizes_of_sets():
    texts = ["", None, "a b", "A B", "one two three four five", "x " * 50, "é\tü\n ß a b c d", "  ", "a b c d e a b c d e a b c d e"]
    values, bounds = words.shingle_sets(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    assert values[bounds[2]] == values[bounds[3]]


@pytest.mark.parametrize(("seed", "block_docs"), [(1, 1000), (2, 1000), (3, 3)])
def test_groups_equal_brute_force(spark, seed, block_docs):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    common = list(rng.choice(vocab, 40))
    for _ in range(25):
        base = list(rng.choice(vocab, int(rng.integers(1, 90))))
        if rng.random() < 0.4:
            base += common
        for _ in range(int(rng.integers(1, 8))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocab))
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "Same"), (i + 4, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as a", "'x' as bucket", "2 as component")
    got = {tuple(r) for r in near_dedup.near_groups(df, near_dedup.Settings(block_docs=block_docs)).collect()}
    assert got == brute(rows)


def test_intersections_equal_brute_force():
    rng = np.random.default_rng(7)
    for n in (2, 30):
        sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)))) for _ in range(n)]
        rows = np.flatnonzero(rng.random(n) < 0.7)
        want = [[len(set(sets[i].tolist()) & set(x.tolist())) for x in sets] for i in rows]
        assert near_dedup.intersections(sets, rows, columns=7).reshape(len(rows), n).tolist() == want


def test_blocks_over_batches():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1000, 40).astype(np.uint64)
    table = {c: [] for c in ("bucket", "i", "j", "doc_id", "component", "role", "set")}
    for bucket in range(6):
        for d in range(int(rng.integers(2, 7))):
            x = np.unique(np.append(base[: int(rng.integers(30, 40))], rng.integers(0, 1000, 2).astype(np.uint64)))
            for c, v in zip(table, (bucket, 0, bucket % 2, bucket * 10 + d, bucket * 10 + d % 3, 3, x.tobytes()), strict=True):
                table[c].append(v)
    whole = pa.record_batch(table)
    want = None
    for step in (100, 1, 3, 5):
        run = near_dedup._within_blocks(near_dedup.Settings(), np.uint64)
        got = pa.Table.from_batches(run(whole.slice(i, step) for i in range(0, whole.num_rows, step))).to_pylist()
        want = want or got
        assert got == want and got


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_groups(odd).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
