"""The filter audit against applying the filters one after the other."""

import re
from itertools import permutations

import pytest

from barwright.llm import filter_audit as A

TEXTS = {
    "fine": " ".join(f"w{i}" for i in range(220)),
    "half": " ".join(f"w{i}" for i in range(110)) + " w0" * 110,
    "just under half": " ".join(f"w{i}" for i in range(109)) + " w0" * 111,
    "199": " ".join(f"w{i}" for i in range(199)),
    "capitals": " ".join(f"W{i}" for i in range(220)),
    "sign": " ".join(f"w{i}" for i in range(220)) + " a|b",
    "all": "A$ " * 300,
    "long": "lorem ipsum dolor " * 60_000,
    "empty": "",
    "null": None,
}
ROWS = [
    *[(i, t, "s1" if i % 2 else "s2") for i, t in enumerate(TEXTS.values())],
    (20, TEXTS["fine"], "s2"), (21, TEXTS["fine"], "s1"), (21, TEXTS["fine"], "s1"), (0, TEXTS["fine"], None), (22, "Case A", ""), (23, "case a", ""),
    (24, None, None), (None, TEXTS["fine"], "s1"), (None, "only here", "s1"), (25, "only here", "s1"), (26, TEXTS["all"], "s2"), (26, TEXTS["all"], "s2"),
]
LABELS = [(0, 1, 0), (1, 1, 1), (3, 1, 1), (6, 0, 1), (20, 1, 0), (21, 0, 0), (21, 1, 1), (22, None, 1), (26, 1, None), (None, 1, 1), (999, 1, 1)]


def expected(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    parts = {}
    for key, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in rows) else set()
        parts.setdefault(part or "", []).append((key, fails))
    out = {}
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in docs if any(g in d[1] for g in order[: step - 1])]
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs),
                    sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed),
                ]
        for f in "ABCDE":
            total = sum(v[1] for (p, order, step), v in out.items() if p == part and order[step - 1] == f)
            for (p, order, step), v in out.items():
                if p == part and order[step - 1] == f:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_equals_filtering_one_after_the_other(spark):
    docs = spark.createDataFrame([(k, t, p, 1, "m", b"d") for k, t, p in ROWS], "doc_id long, text string, source string, n int, mask string, digest binary")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, source string")
    df = A.audit(docs, labels)
    got = result(df)
    assert df.count() == len(got) == 3 * 600
    assert got == expected(ROWS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs.limit(0), labels).count() == 0
    assert result(A.audit(docs, labels)) == expected(ROWS, [])


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 3, 5, 2, 1), ("p", 1, 4, 0, 0), ("p", 0, 7, 7, 0)], "part string, mask int, n long, good long, toxic long")
    got = result(A.interactions(cells, "xy"))
    assert got == {("p", "xy", 1): (7, 9, 0, 4, 2, 1, 13), ("p", "xy", 2): (7, 0, 5, 0, 0, 0, 5), ("p", "yx", 1): (11, 5, 0, 0, 2, 1, 5), ("p", "yx", 2): (7, 4, 5, 4, 0, 0, 13)}
    with pytest.raises(ValueError, match="different letters"):
        A.interactions(cells, "xx")
