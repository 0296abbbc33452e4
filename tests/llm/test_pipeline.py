"""Every stage of the pipeline against plain Python, on what the stage before it kept."""

import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm.queries import PIECE_MODEL

from test_tiling import brute_tiles

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    clean = docs.where("lang is not null").orderBy("doc_id").first().text
    extra = [(100_000, item, None, "planted", 1), (100_001, clean + " \n" + clean, None, "planted", 1), (100_002, clean + "  " + clean, None, "planted", 1),
             (100_003, clean + "\t" + clean + " more", None, "planted", 1), (100_005, None, "en", None, None), (100_006, "", None, None, None),
             (None, "one " + clean + " here", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    base = tmp_path_factory.mktemp("pipeline")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        # names that the operators use themselves
        docs = docs if name == "pieces" else docs.withColumns({"score": F.lit("s"), "text_sha256": F.lit(1), "coverage": F.lit("c"), "component_id": F.lit(0), "copy_id": F.lit(5), "Copy_n": F.lit(6), "rejected": F.lit(False), "tiles": F.lit(7)})
        columns = docs.columns
        stage(spark, docs, DATA).write.parquet(f"{base}/{name}")
        got = spark.read.parquet(f"{base}/{name}")
        out.append((docs.collect(), got.collect()))
        assert name == "pieces" or got.columns == columns
        docs = got
    return dict(zip([name for name, _ in corpus_pipeline.STAGES], out, strict=True))


def by_id(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id))


def test_language(stages):
    before, after = stages["language"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {100_005, 100_006} <= gone
    assert all(r.text is None or not any(c.isalpha() for c in r.text) for r in before if r.doc_id in gone)


def test_exact(stages):
    before, after = stages["exact_dedup"]
    seen, want = set(), []
    for r in by_id(before):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if key not in seen:
            want.append(r)
        seen.add(key)
    assert [r.doc_id for r in by_id(after)] == [r.doc_id for r in want]
    assert 100_001 in {r.doc_id for r in after} and 100_002 not in {r.doc_id for r in after}


def test_near(stages):
    before, after = stages["near_dedup"]
    rows = [r for r in by_id(before) if r.doc_id is not None]
    comp = components([shingles(r.text) for r in rows])
    assert [r.doc_id for r in by_id(after)] == [r.doc_id for i, r in enumerate(rows) if comp[i] == i] + [None]
    assert 100_003 not in {r.doc_id for r in after}


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = []
    for r in by_id(before):
        w = words(r.text)
        parts = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        near = [x for x in items if any(tuple(x[i : i + 5]) in parts for i in range(len(x) - 4))]
        if not any(sum(n for _, _, n in brute_tiles(w, x, 5)) >= 0.75 * len(x) for x in near):
            want.append(r.doc_id)
    assert [r.doc_id for r in by_id(after)] == want
    assert 100_000 not in want


def test_pieces(stages):
    before, after = stages["pieces"]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for r, got in zip(by_id(before), by_id(after), strict=True):
        assert got.ids == sp.encode(r.text or "") and got.n_tokens == len(got.ids) and got.round_trip


def test_run_gives_the_same(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 50
