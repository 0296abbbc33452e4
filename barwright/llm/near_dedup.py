"""Near-duplicate detection: MinHash with banding, signature check, full check, and star components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import Scratch


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, the least similarity (as a ratio of whole numbers), bands and minima per band.

    With 50 bands of 5 a pair at 0.75 shares no band with probability (1 - 0.75**5)**50, about 1.3e-6.
    signature_margin: a pair is dropped before its texts are read if its signatures agree in a share that lies so
    far below the threshold; 0.2 is over seven standard errors of 250 minima. block_docs, block_shingles: about how
    many members, and shingles of members, a block takes of each kind.
    """

    shingle: int = 5
    num: int = 75
    den: int = 100
    bands: int = 50
    rows: int = 5
    signature_margin: float = 0.2
    block_docs: int = 1000
    block_shingles: int = 1 << 20
    seed: int = 11


def _multipliers(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(0, 2**63, s.bands * s.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, bounds: np.ndarray, multipliers: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """(texts, hashes): the least of the top 32 bits of a*x mod 2**64 over each text's values; multiply-shift hashing
    with odd a is universal. Texts without values get the largest number."""
    n = len(bounds) - 1
    out = np.full((n, len(multipliers)), np.uint64(2**64 - 1))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    at = 0
    while at < len(full):  # blocks of whole texts that stay in the CPU's cache
        to = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + block)))
        ids = full[at:to]
        x = values[bounds[ids[0]] : bounds[ids[-1] + 1]]
        starts = bounds[ids] - bounds[ids[0]]
        buffer = np.empty_like(x)
        got = np.empty((len(multipliers), len(ids)), np.uint64)
        for i, a in enumerate(multipliers):
            np.multiply(x, a, out=buffer)
            np.minimum.reduceat(buffer, starts, out=got[i])
        out[ids] = got.T
        at = to
    return (out >> np.uint64(32)).astype(np.uint32)


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def _sign(s: Settings):
    multipliers = _multipliers(s)
    place = words.mix(np.arange(1, s.rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in words.chunks(batch.column(1)):
                part = batch.slice(begin, end - begin)
                values, bounds = words.shingle_sets(part.column(1), s.shingle)
                n = np.diff(bounds)
                sums = [np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)]
                for i, to in enumerate(sums):  # two sums of mixed values tell sets apart as a 128-bit digest does
                    np.cumsum(words.mix(values + np.uint64(i + 1)), out=to[1:])
                least = minima(values, bounds, multipliers)
                keys = (least.astype(np.uint64).reshape(len(n), s.bands, s.rows) * place).sum(axis=2, dtype=np.uint64)
                keys = words.mix(keys + np.arange(s.bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
                has = np.where(n > 0, s.bands, 0)
                flat = keys[n > 0].reshape(-1)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(n.astype(np.int64)),
                        *(pa.array((to[bounds[1:]] - to[bounds[:-1]]).view(np.int64)) for to in sums),
                        pa.array([row.tobytes() for row in least.astype(np.uint16)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]).astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"],
                )
        words.give_back()

    return run


def _agreeing(least: float):
    """Keeps the pairs whose signatures agree in a share of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            ok = (x == y).mean(axis=1) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _sets(s: Settings):
    """The whole shingle sets: sorted 64-bit hashes, and the same cut to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in words.chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                values, bounds = words.shingle_sets(part.column("text"), s.shingle)
                at = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                whole = [values[i:j].tobytes() for i, j in at]
                short = [np.unique(values[i:j].astype(np.uint32)).tobytes() for i, j in at]
                yield pa.record_batch([part.column("doc_id"), pa.array(whole, pa.binary()), pa.array(short, pa.binary())], names=["doc_id", "whole", "short"])
        words.give_back()

    return run


def _similar(s: Settings):
    """Keeps the pairs whose whole shingle sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(*(batch.column(c) for c in ("set_a", "set_b")), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = s.den * both >= s.num * (len(x) + len(y) - both) and both > 0
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: int = 2048) -> np.ndarray:
    """(rows, sets): how many values each of the chosen sets shares with every set."""
    if len(rows) * len(sets) <= 16:
        return np.array([[len(np.intersect1d(sets[i], x, assume_unique=True)) for x in sets] for i in rows.tolist()])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, column = owner[shared], (np.cumsum(n > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [first, first + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[i:j], column[i:j] - first] = 1
        out += has[rows] @ has.T
    return out.astype(np.int64)


#: The part of a member in its block: it is compared with the others, or the others with it, or both.
ASKS, ANSWERS = 1, 2


def _block_links(s: Settings, ids: np.ndarray, comps: np.ndarray, roles: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of members that ask with members of other components that answer: for each asking member and each other
    component the most similar one, as one link joins the components."""
    ask, answer = np.flatnonzero(roles & ASKS), np.flatnonzero(roles & ANSWERS)
    if not len(ask) or not len(answer):
        return ids[:0], ids[:0]
    size = np.array(list(map(len, sets)))
    both = intersections(sets, ask)[:, answer]
    union = size[ask][:, None] + size[answer] - both
    x, y = np.nonzero((s.den * both >= s.num * union) & (both > 0) & (comps[ask][:, None] != comps[answer]))
    ratio = both[x, y] / union[x, y]
    order = np.lexsort((ids[answer[y]], -ratio, comps[answer[y]], x))
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = (np.diff(x) != 0) | (np.diff(comps[answer[y]]) != 0)
    return ids[ask[x[first]]], ids[answer[y[first]]]


def _within_blocks(s: Settings, kind: type):
    """Links in blocks, which come whole and one after the other, if need be over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table) -> pa.RecordBatch:
            key = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1 if len(rows) > 1 else np.empty(0, int)
            ids, comps, roles = (rows.column(c).to_numpy() for c in ("doc_id", "component", "role"))
            sets = [np.frombuffer(v.as_buffer(), kind) for v in rows.column("set")]
            found = [_block_links(s, ids[b:e], comps[b:e], roles[b:e], sets[b:e]) for b, e in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True)]
            x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            return pa.record_batch([np.minimum(x, y), np.maximum(x, y)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = list(zip(*(batch.column(c).to_numpy().tolist() for c in ("bucket", "i", "j")), strict=True))
            last = next((i for i in range(len(key) - 1, 0, -1) if key[i] != key[i - 1]), 0)  # where the block begins that may go on
            if held and tuple(held[-1].column(c)[-1].as_py() for c in ("bucket", "i", "j")) != key[0] or last:
                held.append(batch.slice(0, last))
                if sum(b.num_rows for b in held):
                    yield links(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield links(pa.Table.from_batches(held))
        words.give_back()

    return run


def near_groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of `docs` (doc_id, text).

    1. One pass over the texts gives each document's number of distinct shingles, a digest of its shingle set, its
       minima and its band keys, written to the shared folder.
    2. Equal sets are one class, found with partial minima; the smallest doc_id stands for it from then on.
    3. Class members that share a band key form a bucket. Each member is first paired with the least leader (smallest
       document) of its buckets. Signatures are compared, then the full sets; links become components.
    4. Buckets whose members are all in one component are done. In the others, every member outside the bucket's
       largest component is compared with all members of other components, on full sets, inside blocks of bounded size:
       a task holds some members that ask and some that answer, counts all intersections at once, and gives one link
       for each asking member and other component. So no pairs are written, and no link between components is lost.
       Blocks hold 32-bit hashes, which can only overstate an intersection; links are confirmed on whole hashes, and
       should one fail, the step is done again on those.
    5. Classes give their members the component; the rest stand alone.

    All joins are sort-merge joins, so that a small table runs as a large one does; adaptive execution splits their hot
    partitions. The work of step 4 is a bucket's members times those outside its largest component; only many documents that share
    much text and yet are not similar make that large.

    Null text is empty; documents without words have no shingles, are linked with nothing and kept. Null doc_ids are
    linked with nothing and kept, with a null component. Rows that repeat a doc_id with one text are one node; with
    different texts, their links count for both. Other columns are ignored; an empty table gives no rows.
    """
    s, spark = settings, docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = scratch.keep(docs.mapInArrow(_sign(s), SIGNED), "signed")
    key = ["set_a", "set_b", "n_shingles"]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(usable.groupBy(*key).agg(F.min("doc_id").alias("class_id")), "classes")
    heads = signed.where("n_shingles > 0").join(classes.select(F.col("class_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")

    banded = heads.select("doc_id", F.explode("bands").alias("bucket"))
    # buckets with the same least, greatest and summed members are taken once
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lead"), F.max("doc_id").alias("top"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members")).where("lead < top")
    buckets = scratch.keep(sizes.groupBy("n", "lead", "top", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "lead"), "buckets")
    inside = scratch.keep(banded.join(buckets.hint("merge"), "bucket").select("bucket", "lead", "doc_id"), "inside")
    cand_ids = inside.select("doc_id").distinct().hint("merge")
    cands = scratch.keep(heads.select("doc_id", "n_shingles", "signature").join(cand_ids, "doc_id", "left_semi"), "signatures")
    sets = scratch.keep(docs.join(cand_ids, "doc_id", "left_semi").mapInArrow(_sets(s), "doc_id long, whole binary, short binary"), "sets")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that hold on full sets."""
        whole = lambda c: sets.select(F.col("doc_id").alias(c), F.col("whole").alias(f"set_{c}")).hint("merge")
        return scratch.keep(pairs.join(whole("b"), "b").join(whole("a"), "a").mapInArrow(_similar(s), "a long, b long"), name)

    first = inside.where("lead < doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("lead").alias("a")).select("a", "b")
    sig = lambda c: cands.select(F.col("doc_id").alias(c), F.col("signature").alias(f"sig_{c}")).hint("merge")
    agreed = first.join(sig("b"), "b").join(sig("a"), "a").mapInArrow(_agreeing(s.num / s.den - s.signature_margin), "a long, b long")
    edges = similar(scratch.keep(agreed, "agreed"), "linked")
    comp = scratch.keep(components(edges, scratch, "stars0"), "component0")

    at = inside.select("bucket", "doc_id").join(comp.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    at = scratch.keep(at.join(cands.groupBy("doc_id").agg(F.max("n_shingles").alias("size")).hint("merge"), "doc_id"), "at")
    part = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    whole = part.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "component")).alias("main")).where("parts > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / s.block_docs), F.ceil(size / s.block_shingles)).cast("int")
    open_ = whole.select("bucket", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("ni"), blocks(F.col("n"), F.col("size")).alias("nj"))
    placed = at.join(scratch.keep(open_, "open").hint("merge"), "bucket").withColumn("my_i", F.pmod(F.xxhash64(F.lit("i"), "doc_id"), "ni").cast("int")).withColumn("my_j", F.pmod(F.xxhash64(F.lit("j"), "doc_id"), "nj").cast("int"))
    answers = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(i.alias("i"), F.col("my_j").alias("j"), F.lit(ANSWERS).alias("role")))
    asks = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.struct(F.col("my_i").alias("i"), j.alias("j"), F.when(j == F.col("my_j"), ASKS | ANSWERS).otherwise(ASKS).alias("role")))
    places = F.when(F.col("component") == F.col("main"), answers).otherwise(F.concat(asks, F.filter(answers, lambda p: p["i"] != F.col("my_i"))))
    placed = scratch.keep(placed.select("bucket", "component", "doc_id", F.explode(places).alias("at")).select("bucket", "at.*", "doc_id", "component"), "placed")
    for name, kind in (("short", np.uint32), ("whole", np.uint64)):
        blocked = placed.join(sets.select("doc_id", F.col(name).alias("set")).hint("merge"), "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        found = scratch.keep(blocked.mapInArrow(_within_blocks(s, kind), "a long, b long").distinct(), f"proposed-{name}")
        sure = similar(found, f"confirmed-{name}")
        if sure.count() >= found.count():
            break
    if not sure.isEmpty():
        comp = scratch.keep(components(comp.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(sure), scratch, "stars1"), "component1")

    members = classes.join(comp.withColumnRenamed("node", "class_id").hint("merge"), "class_id", "left").select(*key, F.coalesce("component", "class_id").alias("component_id"))
    members = scratch.keep(members, "members")
    out = signed.join(members.hint("merge"), key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` less all documents of a component but the one with its smallest doc_id, with all their columns.

    Rows with null ids stay, and so do rows that repeat the doc_id that stays.
    """
    go = near_groups(docs, settings).where("not kept").select("doc_id").distinct()
    return docs.join(go.hint("merge"), "doc_id", "left_anti").select(docs.columns)
