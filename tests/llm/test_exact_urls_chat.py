"""Exact groups, URL rules and chat formatting on small fixtures; SQL over whole tables is compared in test_queries."""

import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from barwright.llm import chat, exact_dedup, queries, url_rules


def test_exact_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    long_ = "x" * 70_000
    pool = ["", None, " ", "\t \n", "a  b", "a b", "a\nb", "A b", long_, long_ + "y", long_[:-1] + "z", "é" * 40, "é" * 39 + "e" * 2, "a" * 64, "a" * 65]
    rows = [(i, pool[int(rng.integers(len(pool)))]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit(1), "digit": F.lit("x"), "n": F.lit(2)})
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    want = {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert {tuple(r) for r in exact_dedup.exact_groups(df).collect()} == want
    left = exact_dedup.without_copies(df.withColumn("copy_sha", F.lit(7)))
    assert left.columns == [*df.columns, "copy_sha"] and {r.doc_id for r in left.collect()} == {min(g) for g in groups.values()}


def test_exact_odd_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "c"), (5, "d")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.exact_groups(df).drop("text_sha256").collect()), key=str)
    assert got == sorted([(None, 3, 3, False)] * 2 + [(3, 3, 3, True)] + [(None, None, 2, True)] * 2 + [(5, 5, 2, True)] * 2 + [(5, 5, 1, True)], key=str)
    assert sorted(map(tuple, exact_dedup.without_copies(df).collect()), key=str) == sorted([(3, "a"), (None, "b"), (5, "c"), (5, "d")], key=str)
    assert exact_dedup.exact_groups(df.where("false")).count() == 0 == exact_dedup.without_copies(df.where("false")).count()


def test_urls_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/", "block"), ("Example.net", "/en/x", "block"), (None, "/", "block")]
    hosts = ["net", "NET", "a.net", "example.net", "b.Example.net", "a.example.net", "q.a.example.net", "badexample.com", "example.com", "x.example.com", "org", "w.org", "inet", "", "net."]
    paths = ["", "/", "/en/", "/en", "/en/x", "/en/xy", "/de/", "/fr/1", "?/en/", "#/en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "net/", "://net/", "a://b.net/x://c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "verdict": F.lit(3), "key": F.lit(4), "salt": F.lit(5)})
    df = df.unionByName(df.limit(3))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    want = set()
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        want.add((i, host, path, rule, verdict))
    assert got == want
    odd = spark.createDataFrame([(None, "http://a.net/x"), (1, "http://" + "a." * 50_000 + "net/x"), (None, None)], "page_id long, url string")
    block = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert sorted((r.page_id is None, r.verdict) for r in url_rules.judge_urls(odd, block).collect()) == [(False, "block"), (True, "allow"), (True, "block")]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge_urls(df, none).where("rule is null and verdict = 'allow'").count() == len(urls) + 3
    assert url_rules.judge_urls(df.where("false"), none).count() == 0


def test_url_query_has_no_python(spark):
    plan = queries.op9_url_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_chats_read_back(spark):
    rng = np.random.default_rng(5)
    bits = ["</turn>", "<turn ", "<\\turn", "<\\\\/turn>", "\\", "<", "hi", "\n", "é", "$1", "</turn", queries.HOSTILE, "%3C", ">"]
    rows = []
    for c in [*range(40), None]:
        for t in range(int(rng.integers(1, 9))):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits, int(rng.integers(0, 6))))
            rows.append((c, int(rng.integers(0, 4)) if t % 5 else None, [None, "user", "assistant", "assistant", "a>b<%"][int(rng.integers(5))], text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2)})
    t = chat.format_chats(df)
    got = {r.conv_id: ([tuple(x) for x in r.back], r.loss) for r in t.select("conv_id", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == {c: (x, "".join(s for r, s in x if r == "assistant")) for c, x in want.items()}
    assert chat.format_chats(df.where("false")).count() == 0


def test_long_conversations_take_time_in_proportion(spark):
    def took(n):
        df = spark.range(n).selectExpr("1 as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('é </turn> ', repeat('abc ', 30), id) as text")
        t = chat.format_chats(df)
        began = time.perf_counter()
        got = t.select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("loss_spans").alias("spans")).collect()
        assert [(r.n, r.spans) for r in got] == [(n, n - (n + 2) // 3)]
        assert got[0].loss == "".join(f"é </turn> {'abc ' * 30}{i}" for i in range(n) if i % 3)
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 8 * took(8000) + 2
