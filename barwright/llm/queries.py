"""The operators' queries over the synthetic tables, with their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, exact_dedup, filter_audit, html_text, language, near_dedup, pieces, pii, spelling, tiling, url_rules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The model of the query and the pipeline; a path on the driver.
PIECE_MODEL = os.environ.get("BARWRIGHT_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode(_table(spark, sf_dir, "documents"), PIECE_MODEL, round_trip="round_trip", carry=["doc_id"])
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.digest("ids").alias("ids_sha256"), "round_trip")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


#: Page ids stand for times; each page is asked for again so much later, with the validator that it had.
AGAIN_AFTER = 1000


def captures(pages: DataFrame) -> DataFrame:
    """Two records for each page: the full response, and the not-modified answer to a later request. By the length of
    the html the validator is an ETag, a time, or there is none."""
    size = F.coalesce(F.length("html"), F.lit(0)) % 3
    etag, modified = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("after "), F.length("html"))

    def fields(first: dict, prefix: str) -> F.Column:
        fixed = [F.lit(x) for k, v in first.items() for x in (k, v)]
        validator = F.when(size == 0, F.create_map(F.lit("ETag"), F.concat(F.lit(prefix), etag))).when(size == 1, F.create_map(F.lit("Last-Modified"), modified))
        return F.map_concat(F.create_map(*fixed, F.lit("Date"), F.col("fetched_at").cast("string")), F.coalesce(validator, F.expr("cast(map() as map<string,string>)")))

    first = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("fetched_at"), "html")
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + AGAIN_AFTER).alias("fetched_at"), "html")
    first = first.select("record_id", "url", "fetched_at", F.lit("response").alias("type"), F.lit(200).alias("status"), fields({"Content-Type": "text/html", "Server": "one"}, "").alias("headers"), F.col("html").alias("body"))
    again = again.select("record_id", "url", "fetched_at", F.lit("revisit").alias("type"), F.lit(304).alias("status"), fields({"Server": "two", "Expires": "never", "Content-Length": "0"}, "W/").alias("headers"), F.lit(None).cast("string").alias("body"))
    return first.unionByName(again)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(captures(_table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "key", "refers_to", "verdict", F.sha2(lines, 256).alias("headers_sha256"), F.sha2("body", 256).alias("body_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.coverage(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "n_items", (F.col("n_items") > 0).alias("leaked"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")  # noqa: E731
    of_kind = lambda k: F.filter("base_spans", lambda s: s["kind"] == k)  # noqa: E731
    number = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *number, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), rules)


#: A conversation whose texts hold control strings.
HOSTILE = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    t = chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    digest = F.sha2(F.encode(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), "utf-8"), 256)
    return t.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The ranks of the query; a path on the driver, else the file of the installed vocabularies.
RANK_FILE = os.environ.get("BARWRIGHT_RANK_FILE", "")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file, pattern = RANK_FILE or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = byte_bpe.encode(_table(spark, sf_dir, "documents"), file, pattern, starts=None, packed="packed", carry=["doc_id"])
    back = byte_bpe.decode(got, file, pattern)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_pieces": op2_pieces,
    "op3_near_dedup": op3_near_dedup,
    "op4_language": op4_language,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_url_rules": op9_url_rules,
    "op10_chat_format": op10_chat_format,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_spelling": op12_spelling,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    # words and shingles as text, pairs by shared shingles, components by recursion
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles
            FROM w
        ), e AS (
            SELECT doc_id, unnest(shingles) AS x, len(shingles) AS n FROM s
        ), p AS (
            SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT i, j FROM p WHERE 100 * shared >= 75 * (n - shared)
        ), g AS (
            SELECT i AS a, j AS b FROM l UNION ALL SELECT j, i FROM l
        ), r(doc_id, reach) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.reach
        ), c AS (
            SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1
        )
        SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_warc_revisits": r"""
        WITH u AS (
            SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) AS rest
            FROM pages
        ), p AS (
            SELECT *, lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), '^.*@', '')) AS host,
                   regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                   list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=.*)?$'))) AS params
            FROM u
        ), k AS (
            SELECT page_id, html, coalesce(length(html), 0) % 3 AS kind, '"' || md5(html) || '"' AS etag, 'after ' || length(html) AS modified,
                   CASE WHEN scheme <> '' THEN
                       regexp_replace(CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END, '^www\.', '')
                       || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
            FROM p
        ), j AS (
            SELECT a.*, f.page_id AS found, f.html AS stored,
                   CASE a.kind WHEN 0 THEN f.kind = 0 AND f.etag = a.etag WHEN 1 THEN f.kind = 1 AND f.modified = a.modified ELSE f.kind = 2 END AS fits
            FROM k a ASOF LEFT JOIN (SELECT * FROM k WHERE html IS NOT NULL AND key IS NOT NULL) f ON a.key = f.key AND a.page_id + 1000 > f.page_id
        ), v AS (
            SELECT *, CASE WHEN found IS NULL THEN 'missing' WHEN fits THEN 'resolved' ELSE 'changed' END AS verdict FROM j
        )
        SELECT page_id * 2 + 1 AS record_id, key, CASE WHEN verdict = 'resolved' THEN found * 2 END AS refers_to, verdict,
               sha256(array_to_string(list_sort(list_filter([
                   CASE WHEN verdict = 'resolved' THEN 'content-type: text/html' ELSE 'content-length: 0' END,
                   'date: ' || (page_id + 1000), 'expires: never',
                   CASE WHEN kind = 0 THEN 'etag: W/' || etag END, CASE WHEN kind = 1 THEN 'last-modified: ' || modified END,
                   CASE WHEN verdict = 'resolved' THEN 'server: one' ELSE 'server: two' END], lambda x: x IS NOT NULL)), chr(10))) AS headers_sha256,
               CASE WHEN verdict = 'resolved' THEN sha256(stored) END AS body_sha256
        FROM v""",
    "op9_url_rules": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), h AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u
        ), j AS (
            SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                           WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                           WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                           WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM h
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM j""",
    "op10_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), m AS (
            SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS goes_on,
                   regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') AS escaped,
                   replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E') AS name
            FROM c
        ), g AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   CAST(sum(length(escaped) + length('</turn>') + CASE WHEN goes_on THEN 0 ELSE length('<turn >') + length(name) END) AS BIGINT) AS formatted_chars
            FROM m GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
        FROM g""",
    # crc32 bit by bit, words and strings with one character dropped as text, pairs by equal strings
    "op12_spelling": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
        ), u AS (
            SELECT run, count(*) AS n, doc_id || ':' || run AS s FROM t WHERE length(run) >= 7 GROUP BY doc_id, run
        ), b AS (
            SELECT run, n, flatten(list_transform(list_transform(range(1, length(s) + 1), lambda i: unicode(substring(s, i, 1))),
                                                  lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c // 64), 128 + c % 64] END)) AS bytes
            FROM u
        ), h AS (
            SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda x: list_transform(range(8), lambda k: ((x >> k) & 1)::BIGINT)))),
                                                       lambda c, m: xor(c >> 1, 3988292384::BIGINT * (xor(c, m) & 1)))) AS h
            FROM b
        ), c AS (
            SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h
        ), w AS (
            SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
        ), i AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
        ), d AS (
            SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM i
        ), e AS (
            SELECT DISTINCT d.word AS long, d.n AS long_n, w.word AS short, w.n AS short_n FROM d JOIN w ON d.rest = w.word
        ), p AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION ALL SELECT long, long_n, short, short_n FROM e
            UNION ALL SELECT short, short_n, long, long_n FROM e
        ), q AS (
            SELECT word, any_value(n) AS n, count(*) AS n_near, min(struct_pack(minus_n := -other_n, other := other)) AS best FROM p GROUP BY word
        ), f AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus_n >= 10 * w.n THEN best.other END AS form, CASE WHEN -best.minus_n >= 10 * w.n THEN -best.minus_n END AS form_n
            FROM w LEFT JOIN q USING (word)
        ), r(word, root, goes_on) AS (
            SELECT word, word, true FROM f
            UNION ALL SELECT r.word, f.form, true FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
        ), z AS (
            SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN z USING (word)""",
    "op13_filter_audit": r"""
        WITH RECURSIVE o(filter_order) AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E'])
            UNION ALL SELECT o.filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o.filter_order, f)
        ), s AS (
            SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5
        ), l AS (
            SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1
        ), d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w
            FROM documents
        ), m AS (
            SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails,
                   coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic
            FROM d LEFT JOIN l USING (doc_id)
        ), c AS (
            SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2
        ), x AS (
            SELECT part, filter_order, step, filter_order[step] AS f, fails, n, good, toxic, contains(fails, filter_order[step]) AS hit,
                   len(list_filter(string_split(fails, ''), lambda y: y <> '' AND instr(filter_order, y) < step)) > 0 AS gone
            FROM c, s
        ), g AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
            FROM x GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM g""",
}
