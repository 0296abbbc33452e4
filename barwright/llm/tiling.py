"""Benchmark decontamination: greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import Scratch, set_aside


@dataclass(frozen=True)
class Settings:
    """min_match: words of the shortest tile, and of a seed. threshold: the share of an item's words that a document's
    tiles must cover to count as a leak. least_words: items of fewer words are left out; at 1 an item of one word, such as
    "yes", leaks into every document that has the word. filter_bits: power of two that bounds the table of seeds that is sent to the
    workers (2**28 bits are 32 MB); a benchmark of more than 4 million seeds fills it more, and more seeds go to the join.
    """

    min_match: int = 5
    threshold: float = 0.75
    least_words: int = 1
    filter_bits: int = 28


class Running:
    """Karp-Rabin hashes of all windows of one length, from running sums of powers: any length takes one step a window."""

    def __init__(self, hashed: np.ndarray) -> None:
        self.power, self.inverse = words.powers(len(hashed) + 1)
        self.sums = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(hashed * self.power[: len(hashed)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        n = max(len(self.sums) - length, 0)
        return words.mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length))


def tiles(doc: np.ndarray, item: np.ndarray, k: int, running: Running | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, words) of non-overlapping matches of k words or more, longest
    first; ties go to the first place in the document, then in the item.

    Both are hashed words. The longest length at which unmarked words of both agree is found by halving, as a shorter
    piece of a match agrees too; its matches become tiles; then the next longest is looked for. Windows that agree are
    compared word by word before they are marked. Places are looked up, never paired, so repeated words cost no more.
    running: the document's, where several items are laid over it.
    """
    both = (running or Running(doc), Running(item))
    free = (np.ones(len(doc), bool), np.ones(len(item), bool))
    out: list[tuple[int, int, int]] = []

    def open_(side: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows without marked words."""
        upto = np.append(0, np.cumsum(free[side]))
        at = np.flatnonzero(upto[length:] - upto[: max(len(upto) - length, 0)] == length)
        return at, both[side].windows(length)[at]

    def agree(length: int) -> bool:
        return bool(np.isin(open_(1, length)[1], open_(0, length)[1]).any())

    longest = min(len(doc), len(item))
    while longest >= k and agree(k):
        low, high = k, longest
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if agree(mid) else (low, mid - 1)
        n, (at, h), (theirs, their_h) = low, open_(0, low), open_(1, low)
        order = np.argsort(their_h, kind="stable")
        theirs, their_h = theirs[order], their_h[order]
        at, h = at[here := np.isin(h, their_h)], h[here]
        begin, end = np.searchsorted(their_h, h), np.searchsorted(their_h, h, side="right")
        after: dict[int, int] = {}  # by the first place of a hash, the next of its places that may be free
        for i, first, stop in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True):
            if not free[0][i]:  # within a tile just set; none that starts behind can reach back
                continue
            p = after.get(first, first)
            while p < stop:
                j = int(theirs[p])
                p += 1
                # tiles of this round are as long as the window, so one that overlaps it covers one of its ends
                if free[1][j] and free[1][j + n - 1]:
                    if np.array_equal(doc[i : i + n], item[j : j + n]):
                        out.append((i, j, n))
                        free[0][i : i + n] = False
                        free[1][j : j + n] = False
                    break
            after[first] = p
        longest = n - 1
    return out


def _seeds(hashed: np.ndarray, bounds: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of all windows of these lengths, in texts given by their bounds."""
    running = Running(hashed)
    for n in lengths:
        h = running.windows(n)
        text = np.searchsorted(bounds, np.arange(len(h)), side="right") - 1
        inside = np.arange(n, len(h) + n) <= bounds[text + 1]
        yield text[inside], h[inside]


_PROBES = 4


def _bits(seeds: np.ndarray, probe: int, log_size: int) -> np.ndarray:
    return words.mix(seeds + np.uint64(probe)) >> np.uint64(64 - log_size)


class Filter:
    """A Bloom filter of the items' seeds, of bounded size, and the seeds' lengths."""

    def __init__(self, log_size: int, lengths: list[int], at: np.ndarray, bits: np.ndarray) -> None:
        self.log_size, self.lengths = log_size, lengths
        self.table = np.zeros((1 << log_size) // 64, np.int64)
        self.table[at] = bits

    def passing(self, hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, seed) of the seeds that some item may have."""
        found = []
        for text, h in _seeds(hashed, bounds, self.lengths):
            for probe in range(_PROBES):
                bit = _bits(h, probe, self.log_size).astype(np.int64)
                has = (self.table[bit >> 6] >> (bit & 63)) & 1 == 1
                text, h = text[has], h[has]
            found.append((text, h))
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def _items(benchmark: DataFrame, settings: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, words), numbered, and their seeds (item, item_id, size, n, at, seed): windows of k words at each
    place, or all words of an item with fewer."""
    k = settings.min_match
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = scratch.keep(rows.withColumn("item", F.monotonically_increasing_id()), "items")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in words.chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                w, bounds = words.word_hashes(*words.buffers(part.column("text")))
                yield pa.record_batch([part.column("item"), part.column("item_id"), _binaries(w, bounds)], names=["item", "item_id", "words"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("words")):
                w = np.frombuffer(x.as_buffer(), np.uint64)
                n = min(len(w), k)
                _, h = next(_seeds(w, np.array([0, len(w)]), [n])) if n else (None, np.zeros(0, np.uint64))
                same = [pa.array(np.full(len(h), v, t)) for v, t in ((batch.column("item")[i].as_py(), np.int64), (batch.column("item_id")[i].as_py(), np.int64), (len(w), np.int32), (n, np.int32))]
                yield pa.record_batch([*same, pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))], names=["item", "item_id", "size", "n", "at", "seed"])

    items = scratch.keep(rows.mapInArrow(hashed, "item long, item_id long, words binary").where(F.octet_length("words") >= 8 * settings.least_words), "hashed")
    return items, scratch.keep(items.mapInArrow(seeds, "item long, item_id long, size int, n int, at int, seed long"), "seeds")


def _binaries(w: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([w[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def _filter(seeds: DataFrame, settings: Settings) -> Filter:
    """64 bits a seed and no more than the settings allow; its words are joined on the executors."""
    counted = {r.n: r.seeds for r in seeds.groupBy("n").agg(F.count(F.lit(1)).alias("seeds")).collect()}
    log_size = min(settings.filter_bits, max(16, (64 * sum(counted.values())).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = batch.column("seed").to_numpy().view(np.uint64)
            bit = np.concatenate([_bits(seed, p, log_size) for p in range(_PROBES)]).astype(np.int64)
            yield pa.record_batch([pa.array(bit >> 6), pa.array(np.int64(1) << (bit & 63))], names=["at", "bits"])

    got = seeds.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    lengths = sorted({settings.min_match, *counted}, reverse=True)
    return Filter(log_size, lengths, got.column("at").to_numpy(), got.column("bits").to_numpy())


ADDED = {"item_id": "long", "coverage": "double", "n_tiles": "long", "n_items": "long", "tiles": "array<struct<start:int,words:int>>"}
#: Two sums over a text's words and their places, which stand for the text, and whether it may hold an item's seed.
_KEY = ("tile_key_a", "tile_key_b")
_HIT = "tile_hit"
_TILES = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))


def _flag(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filter = shared.value
        for batch in batches:
            for begin, end in words.chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                w, bounds = words.word_hashes(*words.buffers(part.column("text")))
                place = np.arange(len(w), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
                keys = []
                for i in (1, 2):
                    sums = np.append(np.uint64(0), np.cumsum(words.mix(w + words.mix(place * np.uint64(2) + np.uint64(i)))))
                    keys.append(pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)))
                hit = np.zeros(part.num_rows, bool)
                hit[f.passing(w, bounds)[0]] = True
                yield pa.record_batch([*part.columns, *keys, pa.array(hit)], names=[*part.schema.names, *_KEY, _HIT])
            words.give_back()

    return run


def _seeds_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filter = shared.value
        for batch in batches:
            for begin, end in words.chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                text, seed = f.passing(*words.word_hashes(*words.buffers(part.column("text"))))
                seed = seed[order := np.lexsort((seed, text))]
                text = text[order]
                new = np.ones(len(text), bool)
                new[1:] = (np.diff(text) != 0) | (seed[1:] != seed[:-1])
                keys = [part.column(c).take(pa.array(text[new])) for c in _KEY]
                yield pa.record_batch([*keys, pa.array(seed[new].view(np.int64))], names=[*_KEY, "seed"])
            words.give_back()

    return run


def _tile(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc, running = None, np.zeros(0, np.uint64), None
        for batch in batches:
            texts, rows = batch.column("text"), []
            keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True))
            for i in range(batch.num_rows):
                if keys[i] != last:
                    last, (doc, _) = keys[i], words.word_hashes(*words.buffers(texts.slice(i, 1)))
                    running = Running(doc)
                item = np.frombuffer(batch.column("words")[i].as_buffer(), np.uint64)
                got = tiles(doc, item, min(settings.min_match, len(item)), running)
                if got:
                    rows.append((i, sum(t[2] for t in got) / len(item), len(got), [{"start": t[0], "words": t[2]} for t in sorted(got)]))
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.float64(), pa.int64(), _TILES)
            columns = [*(batch.column(c).take(at) for c in (*_KEY, "item_id")), *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))]
            yield pa.record_batch(columns, names=[*_KEY, "item_id", "coverage", "n_tiles", "tiles"])
        words.give_back()

    return run


def coverage(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` with the best covered item added: item_id (the smallest of equals; null if none shares a
    tile), coverage (share of its words), n_tiles, n_items (items covered to the threshold) and tiles (start and length
    in words of the document).

    The words are those of the near-duplicate operator (ASCII white space apart, A-Z folded). A seed is a window of
    min_match words, or all words of a shorter item; reordered passages are found piece by piece.

    1. A Bloom filter of the items' seeds, of bounded size, is the only thing that is broadcast. Documents without a
       passing seed are done where they are read; no others are shuffled.
    2. The others, one of each text, are joined with the items on their passing seeds, numbers without texts. Adaptive
       execution splits a seed that very many documents or items have. What the shared seeds of a pair cover of its
       item bounds what its tiles can.
    3. Of each document the pair of the highest bound is tiled (`tiles`), and then those only whose bound reaches the
       threshold or what the first one covers. So a phrase that is in all items and documents costs a row of numbers a
       pair, and a tiling a document. The best item and the number of leaks are taken with partial maxima and sums.

    Null and empty texts share nothing; items without words, text or id are ignored; equal rows of items count once;
    items of different text may share an id and count one by one; rows that repeat get the same answer, null ids need
    no care; empty tables give no rows, or no matches. Columns of the added names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "tiles")
    items, seeds = _items(benchmark, settings, scratch)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(seeds, settings))
    own = docs.drop(*ADDED)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), *(f"{c} long" for c in _KEY), f"{_HIT} boolean"])
    flagged = own.mapInArrow(_flag(shared), schema)
    hits = scratch.keep(flagged.where(_HIT).drop(_HIT), "hits")

    texts = scratch.keep(hits.select("text", *_KEY).dropDuplicates(_KEY), "texts")
    doc = list(_KEY)
    met = texts.mapInArrow(_seeds_of(shared), f"{_KEY[0]} long, {_KEY[1]} long, seed long").join(seeds.hint("merge"), "seed")
    places = met.groupBy(*doc, "item", "item_id", "size", "n").agg(F.sort_array(F.collect_set("at")).alias("at"))
    gaps = F.zip_with(F.slice("at", F.lit(2), F.size("at")), F.slice("at", F.lit(1), F.size("at") - 1), lambda b, a: F.least(b - a, F.col("n")))
    covered = F.aggregate(gaps, F.col("n"), lambda total, x: total + x)
    pairs = scratch.keep(places.select(*doc, "item", "item_id", (covered / F.col("size")).alias("bound")), "pairs")

    schema = f"{_KEY[0]} long, {_KEY[1]} long, item_id long, coverage double, n_tiles long, tiles {ADDED['tiles']}"

    def tiled(chosen: DataFrame, name: str) -> DataFrame:
        matched = chosen.select(*doc, "item").join(items.hint("merge"), "item").join(texts.hint("merge"), doc)
        return scratch.keep(matched.select(*doc, "text", "item_id", "words").mapInArrow(_tile(settings), schema), name)

    top = pairs.groupBy(*doc).agg(F.max_by(F.struct("item", "item_id"), F.struct("bound", -F.col("item_id"), -F.col("item"))).alias("top"))
    top = scratch.keep(top.select(*doc, F.col("top.item").alias("item"), F.col("top.item_id").alias("first_id")), "top")
    first = tiled(top, "first")
    best_yet = top.withColumnRenamed("item", "first").join(first.select(*doc, "coverage").hint("merge"), doc, "left")
    held = pairs.join(best_yet.hint("merge"), doc).where(F.col("item") != F.col("first"))
    yet = F.coalesce("coverage", F.lit(0.0))
    open_ = (F.col("bound") >= settings.threshold) | (F.col("bound") > yet) | ((F.col("bound") == yet) & (F.col("item_id") <= F.col("first_id")))
    both = first.unionByName(tiled(held.where(open_), "others"))
    best = F.max_by(F.struct("item_id", "coverage", "n_tiles", "tiles"), F.struct("coverage", -F.col("item_id"), -F.col("n_tiles"), "tiles"))
    found = both.groupBy(*doc).agg(best.alias("best"), F.sum((F.col("coverage") >= settings.threshold).cast("long")).alias("n_items"))

    empty = {"item_id": F.lit(None), "coverage": F.lit(0.0), "n_tiles": F.lit(0), "n_items": F.lit(0), "tiles": F.array()}
    got = {c: F.col(c if c == "n_items" else f"best.{c}") for c in ADDED}
    clean = flagged.where(~F.col(_HIT)).withColumns({c: v.cast(ADDED[c]) for c, v in empty.items()})
    others = hits.join(found.hint("merge"), doc, "left")
    others = others.withColumns({f"tile {c}": F.coalesce(got[c], empty[c].cast(ADDED[c])) for c in ADDED}).drop("best", "n_items").withColumnsRenamed({f"tile {c}": c for c in ADDED})
    return clean.select(*own.columns, *ADDED).unionByName(others.select(*own.columns, *ADDED))


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` that cover no item to the threshold, with all their columns as they were."""
    rows, back = set_aside(docs, (*ADDED, *_KEY, _HIT, "best"))
    return back(coverage(rows, benchmark, settings).where(F.col("n_items") == 0))
