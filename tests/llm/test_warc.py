"""Revisits against a brute-force search."""

import numpy as np
from pyspark.sql import functions as F

from barwright.llm import warc

SCHEMA = "record_id long, url string, fetched_at long, type string, status int, headers map<string,string>, body string"


def brute(rows, keys):
    out = []
    for rid, url, at, type_, status, h, _ in rows:
        if type_ != "revisit" or status != 304:
            continue
        h = {k.lower(): v for k, v in (h or {}).items()}
        key = keys[url]
        before = [r for r in rows if key is not None and at is not None and r[3] == "response" and r[4] == 200 and r[6] is not None and r[0] is not None and keys[r[1]] == key and r[2] is not None and r[2] < at]
        last = max(before, key=lambda r: (r[2], r[0]), default=None)
        theirs = {k.lower(): v for k, v in (last[5] or {}).items()} if last else {}
        bare = lambda e: e.strip().removeprefix("W/") if e else e
        if last is None:
            out.append((rid, key, None, "missing", tuple(sorted(h.items())), None))
            continue
        if "etag" in h:
            ok = bare(h["etag"]) == bare(theirs.get("etag"))
        elif "last-modified" in h:
            ok = h["last-modified"] == theirs.get("last-modified")
        else:
            ok = "etag" not in theirs and "last-modified" not in theirs
        merged = theirs | {k: v for k, v in h.items() if k in warc.PERMITTED}
        out.append((rid, key, last[0], "resolved", tuple(sorted(merged.items())), last[6]) if ok else (rid, key, None, "changed", tuple(sorted(h.items())), None))
    return sorted(out, key=str)


def test_revisits_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    urls = ["http://a.org/x", "HTTP://www.A.org:80/x/#top", "https://a.org/x?utm_source=f", "http://a.org/y?b=2&a=1", "http://a.org/y?a=1&b=2", None, "no url", "http://b.org"]
    weights = np.array([30, 8, 8, 3, 3, 1, 1, 3]) / 57  # one URL has most records
    rows = []
    for i in range(500):
        url = urls[rng.choice(len(urls), p=weights)]
        at = None if rng.random() < 0.02 else int(rng.integers(0, 300))
        h = [None, {}, {"ETag": '"1"'}, {"etag": 'W/"1"', "Server": "s"}, {"ETag": '"2"', "Content-Length": "9"}, {"Last-Modified": "m", "Date": str(i)}, {"X": "y", "Expires": "never"}][rng.integers(0, 7)]
        if rng.random() < 0.4:
            rows.append((i, url, at, "response", int(rng.choice([200, 200, 200, 404])), h, None if rng.random() < 0.1 else f"body {i}"))
        else:
            rows.append((i, url, at, str(rng.choice(["revisit", "revisit", "request"])), 304, h, None))
    rows += [rows[-1], (None, "http://a.org/x", 5, "response", 200, {}, "b"), (None, "http://b.org/", 999, "revisit", 304, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    keys = {r.url: r.key for r in df.select("url", warc.canonical_url(F.col("url")).alias("key")).distinct().collect()}
    assert keys["http://a.org/x"] == keys["HTTP://www.A.org:80/x/#top"] == keys["https://a.org/x?utm_source=f"] == "a.org/x"
    assert keys["http://a.org/y?b=2&a=1"] == keys["http://a.org/y?a=1&b=2"] == "a.org/y?a=1&b=2"
    assert keys[None] is None and keys["no url"] is None and keys["http://b.org"] == "b.org/"
    got = warc.resolve(df.withColumn("key", F.lit(1)).withColumn("verdict", F.lit("x"))).collect()
    assert sorted(((r.record_id, r.key, r.refers_to, r.verdict, tuple(sorted(r.headers.items())), r.body) for r in got), key=str) == brute(rows, keys)
    assert {r.verdict for r in got} == {"missing", "resolved", "changed"}
    assert warc.resolve(df.where("false")).count() == 0
