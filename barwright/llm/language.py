"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, set_aside
from .words import chunks, give_back

ORDER = 5
#: Bits of a symbol, so that ORDER of them make one key; so many letters, less three, have symbols of their own.
BITS = 12
SPACE, OTHER = 1, 2
#: Bytes of text judged at once.
CHUNK_BYTES = 1 << 19


@dataclass(frozen=True)
class Settings:
    """docs_per_lang: about so many labelled documents of each language are learnt from, picked by a hash of the id;
    this bounds what is fitted on, and with it the model. One in calibrate_every of them is set apart to calibrate on.
    max_langs: of more values of lang the most frequent are learnt.

    A text is rejected beyond median + stretch * (quantile - median) of the cross-entropies that calibration texts of its
    language and length had.
    """

    docs_per_lang: int = 1200
    calibrate_every: int = 4
    max_langs: int = 500
    quantile: float = 0.99
    stretch: float = 5.0


_POINTS = 0x110000


class Alphabet:
    """Maps code points to symbols: 0 unused, 1 not a letter, 2 any other letter, then the letters learnt."""

    def __init__(self, known: np.ndarray) -> None:
        self.table = np.fromiter((OTHER if chr(c).isalpha() else SPACE for c in range(_POINTS)), np.uint16, _POINTS)
        self.table[known] = np.arange(3, 3 + len(known))
        self.size = 3 + len(known)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return self.table[points]


def encode(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the ORDER symbols that end at each letter or word end, their bounds by text, and letters by text.

    Every text starts with ORDER - 1 spaces, so that its first letters have a context too.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    texts = [t.lower() for t in texts]
    lead = " " * (ORDER - 1)
    lengths = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    joined = "".join(lead + t for t in texts)
    sym = alphabet.symbols(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    space = sym == SPACE
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    lead_at = (begins[:, None] + np.arange(ORDER - 1)).reshape(-1)
    keep[lead_at] = True
    at = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    sym = sym[keep].astype(np.int64)
    begins, ends = at[begins], at[ends]
    key = np.zeros(len(sym), np.int64)
    for j in range(ORDER):
        key[ORDER - 1 :] |= sym[j : len(sym) - ORDER + 1 + j] << np.int64(BITS * (ORDER - 1 - j))
    counted = np.ones(len(sym), bool)
    counted[(begins[:, None] + np.arange(ORDER - 1)).reshape(-1)] = False
    n = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(counted, out=n[1:])
    is_letter = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(sym != SPACE, out=is_letter[1:])
    return key[counted], np.append(n[begins], n[ends[-1:]]), is_letter[ends] - is_letter[begins]


class KneserNey:
    """One language's model. For each order a sorted array of hashed n-grams with their discounted probabilities, and
    one of hashed contexts with the weight that interpolation gives the next lower order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, symbols: int) -> None:
        self.symbols = symbols
        self.levels = []
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order].astype(np.float64)
        for n in range(ORDER, 0, -1):
            context = grams >> np.int64(BITS)
            total_of, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, counts)
            kinds = np.bincount(inverse)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            p = np.maximum(counts - discount, 0) / total[inverse]
            self.levels.append((*self._sorted(grams, p), *self._sorted(total_of, discount * kinds / total)))
            # the lower order counts the different symbols that stand before an n-gram
            grams, counts = np.unique(grams & np.int64((1 << BITS * (n - 1)) - 1), return_counts=True)
            counts = counts.astype(np.float64)

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        return keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def _sorted(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.hashed(keys)
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _find(h: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(h, keys), len(h) - 1)
        return np.where(h[at] == keys, values[at], np.float32(missing))

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of each key's last symbol after the others, in bits."""
        p = np.full(len(keys), 1 / self.symbols)
        for n in range(1, ORDER + 1):
            gh, gv, ch, cv = self.levels[ORDER - n]
            own = keys & np.int64((1 << BITS * n) - 1)
            p = self._find(gh, gv, self.hashed(own), 0.0) + self._find(ch, cv, self.hashed(own >> np.int64(BITS)), 1.0) * p
        return np.log2(p)


class Detector:
    """The models of all languages and the rejection limits."""

    def __init__(self, langs: list[str], models: list[KneserNey], alphabet: Alphabet) -> None:
        self.langs, self.models, self.alphabet = langs, models, alphabet
        #: By language the logarithms of lengths, and the cross-entropy there beyond which a text is rejected.
        self.limits: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1), np.full(1, np.inf)) for _ in langs]

    def limit(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(lang)), np.log(np.maximum(n, 1))
        for i, (x, y) in enumerate(self.limits):
            out[lang == i] = np.interp(at[lang == i], x, y)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts x languages), symbols and letters by text."""
        if not texts:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, bounds, n_letters = encode(texts, self.alphabet)
        known, inverse = np.unique(keys, return_inverse=True)
        n = np.diff(bounds)
        out = np.zeros((len(texts), len(self.langs)))
        text_of = np.repeat(np.arange(len(texts)), n)
        for i, model in enumerate(self.models):
            bits = -model.log2(known).astype(np.float64)
            out[:, i] = np.bincount(text_of, bits[inverse], minlength=len(texts))
        return out / np.maximum(n, 1)[:, None], n, n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        h, n, n_letters = self.entropies(texts)
        if not len(h):
            return [], np.zeros(0), np.zeros(0, bool)
        best = h.argmin(axis=1)
        # posterior of the best language; long texts don't count as so many independent symbols
        gap = (h.min(axis=1)[:, None] - h) * np.minimum(n, 40)[:, None]
        score = 1 / np.exp2(gap).sum(axis=1)
        none = n_letters == 0
        rejected = none | (h.min(axis=1) > self.limit(best, n))
        return ["und" if z else self.langs[b] for b, z in zip(best.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, score), rejected


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _gram_counts(alphabet: Alphabet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                lang = part.column("lang").dictionary_encode()
                index = np.asarray(lang.indices)
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    keys, _, _ = encode(part.column("text").filter(pa.array(index == i)).to_pylist(), alphabet)
                    grams, counts = np.unique(keys, return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    return run


def fit(docs: DataFrame, settings: Settings = Settings()) -> Detector | None:
    """Learns from the text and lang of labelled rows that are not held out; None if there are none.

    Rows are counted by language first (one count a language comes to the driver); of each, a hash of the id picks about
    settings.docs_per_lang, which are written to the shared folder. What the driver gathers (n-gram counts of that
    sample, summed on the executors) grows with the languages and not with the input.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.max_langs).collect()}
    if not sizes:
        return None
    rank = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20))
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, int((1 << 20) * settings.docs_per_lang / n) + 1))])[F.col("lang")]
    for_fit = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(settings.calibrate_every)) != 0
    sample = labelled.where(rank < bound).select("text", "lang", for_fit.alias("for_fit"))
    sample = Scratch(docs.sparkSession, "language").keep(sample, "sample")
    fitted = sample.where("for_fit").select("text", "lang")
    # letters of the languages, the most frequent ones with symbols of their own
    seen = fitted.mapInArrow(_letter_counts, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "letter").limit((1 << BITS) - 4).collect()
    alphabet = Alphabet(np.sort(np.array([r[0] for r in top if r[1] > 1], np.int64)))
    counts = fitted.mapInArrow(_gram_counts(alphabet), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    name, gram, n = counts.column("lang").combine_chunks(), counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    langs = sorted(set(name.unique().to_pylist()))
    if not langs:  # no labelled text has a letter, or all few are set apart
        return None
    models = []
    for lang in langs:
        of = np.asarray(pa.compute.equal(name, lang))
        models.append(KneserNey(gram[of], n[of], alphabet.size))
    detector = Detector(langs, models, alphabet)
    _calibrate(detector, sample.where("not for_fit"), settings)
    return detector


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in chunks(batch.column("text"), CHUNK_BYTES):
            text = "".join(batch.column("text").slice(begin, end - begin).to_pylist()).lower()
            points, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            ok = np.array([chr(c).isalpha() for c in points.tolist()], bool)
            yield pa.record_batch([pa.array(points[ok].astype(np.int32)), pa.array(n[ok])], names=["letter", "n"])


#: Bounds of the classes of length (symbols) that are calibrated one by one, and the characters cut from the middle of
#: each longer text, so that every class is filled.
CLASSES = (1, 10, 25, 50, 100, 200, 1000, 1 << 62)
PIECES = (6, 15, 40, 80, 160, 500)
#: Texts that a class needs; else a neighbouring class counts for its lengths too.
LEAST = 20


def _limits(h: np.ndarray, n: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """Logarithms of the classes' median lengths and their limits, which don't rise with length; None without a class."""
    at, limit = [], []
    for low, high in pairwise(CLASSES):
        of = (n >= low) & (n < high)
        if of.sum() >= LEAST:
            middle, far = np.quantile(h[of], [0.5, settings.quantile])
            at.append(np.log(np.median(n[of])))
            limit.append(middle + settings.stretch * (far - middle))
    return (np.array(at), np.maximum.accumulate(limit[::-1])[::-1]) if at else None


def _calibrate(detector: Detector, sample: DataFrame, settings: Settings) -> None:
    """Rejection limits by language and length, from documents that the models have not seen. A text that another model
    likes better than its label's may be labelled wrongly, and says nothing about what the language's texts look like."""
    shared = sample.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d: Detector = shared.value
        for batch in batches:
            for begin, end in chunks(batch.column("text"), CHUNK_BYTES // 4):
                part = batch.slice(begin, end - begin)
                cut = list(zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True))
                cut += [(t[len(t) // 2 :][:k], lang) for t, lang in cut for k in PIECES if len(t) > 2 * k]
                h, n, letters = d.entropies([t for t, _ in cut])
                best = h.argmin(axis=1) if len(h) else np.zeros(0, np.int64)
                right = np.array([lang == d.langs[b] for (_, lang), b in zip(cut, best.tolist(), strict=True)], bool) & (letters > 0)
                yield pa.record_batch([pa.array(best[right].astype(np.int32)), pa.array(h.min(axis=1)[right] if len(h) else []), pa.array(n[right])], names=["lang", "h", "n"])

    got = sample.select("text", "lang").mapInArrow(run, "lang int, h double, n long").toArrow()
    lang, h, n = (got.column(c).to_numpy() for c in ("lang", "h", "n"))
    for i in range(len(detector.langs)):
        detector.limits[i] = _limits(h[lang == i], n[lang == i], settings) or detector.limits[i]


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` with held_out, lang_pred, score (0 to 1) and rejected added.

    The language is the one whose model has the lowest cross-entropy per symbol over the whole text. `und` with
    score 0 where the text is null or has no letter, or nothing could be learnt; such rows are rejected, and so are
    texts whose cross-entropy lies far above what calibration texts of the predicted language and their length had; a
    language with fewer than LEAST calibration texts of every length rejects nothing. lang, source and doc_id are no inputs
    of a prediction. Ties go to the language that sorts first. Repeated rows are judged one by one; columns of the added
    names are replaced; other columns stay; an empty table gives no rows.
    """
    detector = fit(docs, settings)
    added = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    docs = docs.drop("held_out", *added).withColumn("held_out", _held_out())
    if detector is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + ", ".join(f"{k} {v}" for k, v in added.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                lang, score, rejected = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
                columns = [*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.record_batch(columns, names=[*part.schema.names, *added])
        give_back()

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` that `identify` doesn't reject, with all their columns as they were."""
    rows, back = set_aside(docs, ("held_out", "lang_pred", "score", "rejected"))
    return back(identify(rows, settings).where(~F.col("rejected")))
