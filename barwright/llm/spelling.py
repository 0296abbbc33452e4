"""Words that differ by one character, and the frequent form that each rare one stands for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .words import chunks, give_back, mix, powers

RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words worked on at once; each character becomes a key of 40 bytes or so.
BLOCK_BYTES = 1 << 16
#: Leading bits of a key by which keys are dealt out.
RADIX_BITS = 16
KEY_SCHEMA = "key long, place int, id long, n long, new boolean"


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 7, least_count: int = 2) -> DataFrame:
    """word and n: runs of letters in lower case (A-Z only), of each 31st (by a hash of key and run) one character dropped;
    those with enough characters and occurrences. Null texts have none; a null key hashes as ''."""
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUNS), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).where(F.char_length("run") >= least_chars)
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = lowered.withColumn("h", hashed).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def deletion_keys(ids: np.ndarray, counts: np.ndarray, words: list[str], key_bits: int = 64) -> pa.RecordBatch:
    """A key for each word as it is (place -1), and one for each character dropped. `new` is false where the character
    before is the same one, so dropping either gives the same string.

    The hash of a string is the sum of its mixed characters times powers of a base, modulo 2^64. What is before the
    dropped character counts as it is, what is after moves down by one power."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - np.repeat(begins, sizes)
    power, inverse = powers(int(sizes.max(initial=1)) + 1)
    terms = mix(chars + np.uint64(1)) * power[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    prefix = sums[:-1] - np.repeat(sums[begins], sizes)
    suffix = np.repeat(sums[begins + sizes], sizes) - sums[1:]
    salt = lambda n: mix(n.astype(np.uint64))
    dropped = mix(prefix + suffix * inverse[1] + salt(np.repeat(sizes - 1, sizes)))
    whole = mix(sums[begins + sizes] - sums[begins] + salt(sizes))
    new = np.ones(len(chars), bool)
    new[1:] = (chars[1:] != chars[:-1]) | (place[1:] == 0)
    each = lambda x: np.concatenate([x, np.repeat(x, sizes)])
    keys = np.concatenate([whole, dropped]) >> np.uint64(64 - key_bits) << np.uint64(64 - key_bits)
    columns = [keys.view(np.int64), np.concatenate([np.full(len(words), -1), place]).astype(np.int32), each(ids), each(counts), np.concatenate([np.ones(len(words), bool), new])]
    return pa.record_batch([pa.array(c) for c in columns], names=["key", "place", "id", "n", "new"])


def _keys(key_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, words = batch.column("id"), batch.column("n"), batch.column("word")
            for begin, end in chunks(words, BLOCK_BYTES):
                cut = lambda c: c.slice(begin, end - begin)  # noqa: B023, E731
                yield deletion_keys(np.asarray(cut(ids)), np.asarray(cut(counts)), cut(words).to_pylist(), key_bits)
        give_back()

    return run


def near_words(words: DataFrame, key_bits: int = 64) -> DataFrame:
    """For each word with any, id, n_near (how many words differ from it by one character put in, left out or replaced) and
    best (struct of -n and id: its near word of the largest n, of the smallest id among equals). words: id, word, n, each
    word once, with ids in the order of the words.

    Two words of one length differ in the character at a place if both without it are the same; a word is another with a
    character left out if it is that one's string without the character. So the keys' groups hold all near words, a group
    has at most as many words as there are letters, and counts and the two best of a group do without pairs. Keys are
    dealt out by their leading bits and sorted; groups of one go; then strings tell equal keys of different strings apart
    (fewer `key_bits` make more of them, with the same result).
    """
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    keys = words.select("id", "word", "n").mapInArrow(_keys(key_bits), KEY_SCHEMA).withColumn("radix", radix)
    alike = Window.partitionBy("radix", "key")
    shared = keys.repartition("radix").withColumn("size", F.count(F.lit(1)).over(alike)).where("size > 1").drop("size")
    left = F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.char_length("word")))
    rows = shared.join(words.select("id", "word"), "id").withColumn("rest", F.when(F.col("place") < 0, F.col("word")).otherwise(left)).drop("word")

    string = Window.partitionBy("radix", "key", "rest")
    slot = Window.partitionBy("radix", "key", "rest", "place")
    ranked = slot.orderBy(F.desc("n"), "id")
    all_ranked = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    standing = F.struct((-F.col("n")).alias("minus_n"), "id")
    drops = F.col("place") >= 0
    seen = rows.repartition("radix").select(
        "id",
        "place",
        "new",
        F.row_number().over(ranked).alias("rank"),
        F.count(F.lit(1)).over(slot).alias("in_slot"),
        F.nth_value(standing, 1).over(all_ranked).alias("first"),
        F.nth_value(standing, 2).over(all_ranked).alias("second"),
        F.min(F.when(~drops, standing)).over(string).alias("itself"),
        F.count(F.when(drops & F.col("new"), 1)).over(string).alias("longer"),
        F.min(F.when(drops & F.col("new"), standing)).over(string).alias("best_longer"),
    )
    replaced = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    shorter = F.when(F.col("new"), F.col("itself"))
    found = seen.select(
        "id",
        F.when(drops, F.col("in_slot") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("longer")).alias("n_near"),
        F.when(drops, F.least(replaced, shorter)).otherwise(F.col("best_longer")).alias("best"),
    )
    return found.where("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """id and last: where following `form` from each id ends. A form's n is ten times its word's, so no chain is longer
    than 18; each round doubles what a row has followed."""
    now = scratch.keep(forms.select("id", F.col("form").alias("last")), "last 0")
    done = 0
    while True:
        ahead = now.select(F.col("id").alias("last"), F.col("last").alias("further"))
        done += 1
        after = scratch.keep(now.join(ahead, "last", "left").select("id", F.coalesce("further", "last").alias("last"), F.col("further").isNotNull().alias("moved")), f"last {done}")
        if not after.where("moved").take(1):
            return after.drop("moved")
        now = after.drop("moved")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", times: int = 10) -> DataFrame:
    """One row a word: word, form (its near word of the largest n, the smallest in code-point order among equals, if that n
    is `times` the word's at least; else null), root (where following forms from the word ends), n, n_near, form_n.

    See `word_counts` for the words and for null texts and keys; repeated rows count again; an empty table gives no rows;
    other columns don't matter. A very long word costs a key a character, none of which carries the word.
    """
    if times < 2:
        raise ValueError("times must be 2 at least, or forms could go round in circles")
    scratch = Scratch(docs.sparkSession, "spelling")
    # the order of the ids is the order of the words; written, so that ids stay
    words = scratch.keep(word_counts(docs, text, key).orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = near_words(words).select("id", "n_near", F.col("best.id").alias("best"), (-F.col("best.minus_n")).alias("best_n"))
    known = F.col("best_n") >= F.lit(times) * F.col("n")
    judged = scratch.keep(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n")), "judged")
    last = last_forms(judged.where(F.col("form").isNotNull()), scratch)
    named = lambda a, b: words.select(F.col("id").alias(a), F.col("word").alias(b))
    out = judged.join(named("form", "form_word"), "form", "left").join(last, "id", "left").join(named("last", "last_word"), "last", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("last_word", "word").alias("root"), "n", "n_near", "form_n")
