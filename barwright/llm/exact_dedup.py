"""Exact dedup by distributed MSD radix partitioning: groups are split by successive bytes, no digest decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, set_aside

#: Bytes of the first digit; each later one is eight times as long as the one before.
FIRST_DIGIT = 64
GROWTH = 8


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digit(start: int, length: int) -> Column:
    return F.substring(F.col("bytes"), start + 1, length)


def exact_groups(docs: DataFrame) -> DataFrame:
    """The columns doc_id, keep_id (smallest doc_id of the equal texts), group_size, kept and text_sha256, one row per row.

    Level by level, the rows of each group that is not yet settled are split by their next bytes: the group key is
    (group, digit), counted with map-side partial sums, so that a group with a third of all rows sends one row per
    task. Groups of one row and groups whose bytes have ended are settled; only the others go on to the next level.
    The first digit also holds the byte length, so a group's texts all end together. Digits grow geometrically,
    so the longest text takes about log8 of its length in levels. The joins back have a written table on each
    side, which lets adaptive execution split a hot group's rows.

    A null doc_id takes part in its group but is only its keep_id if the whole group has none (kept is then true).
    Repeated rows count one by one, and rows that share the smallest doc_id of their group are all kept.
    Texts of any length are compared whole. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.encode(normalised(F.col("text")), "utf-8")
    rows = docs.select("doc_id", text.alias("bytes")).withColumn("size", F.length("bytes")).withColumn("text_sha256", F.sha2("bytes", 256))
    active = rows.withColumn("group", F.lit(0).cast("long"))
    done, start, length, level = [], 0, FIRST_DIGIT, 0
    while True:
        key = ["group", "size", "digit"] if level == 0 else ["group", "digit"]
        split = active.withColumn("digit", _digit(start, length))
        counts = split.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")
        # numbers of groups need only tell apart those that share no key, so the row of the table will do
        groups = scratch.keep(counts.withColumn("next", F.monotonically_increasing_id()), f"groups{level}")
        joined = split.join(groups.hint("merge"), key, "left")
        over = F.col("size") <= start + length
        settled = F.col("n").isNull() | over
        part = scratch.keep(
            joined.select("doc_id", "text_sha256", "size", F.when(~settled, F.col("bytes")).alias("bytes"), F.when(~settled, F.col("next")).alias("group"), settled.alias("settled"),
                          F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size")),
            f"rows{level}",
        )
        done.append(part.where("settled"))
        active = part.where("not settled").select("doc_id", "bytes", "size", "text_sha256", "group")
        if level:
            scratch.drop(f"groups{level}")
        if active.isEmpty():
            break
        start, length, level = start + length, length * GROWTH, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` less all but one of each group of equal texts, with all their columns as they were.

    The row with the smallest doc_id stays; of rows that share it, and where all ids are null, any one does. Null texts
    are equal to empty ones. The radix groups decide what is equal; the digest only tells apart the texts of rows
    that share an id.
    """
    rows, back = set_aside(docs, ("copy_id", "copy_sha", "copy_n"))
    kept = exact_groups(docs).where("kept").groupBy(F.col("doc_id").alias("copy_id"), F.col("text_sha256").alias("copy_sha")).agg(F.count(F.lit(1)).alias("copy_n"))
    kept = Scratch(docs.sparkSession, "kept").keep(kept, "kept")
    sha = F.sha2(F.encode(normalised(F.col("text")), "utf-8"), 256)

    def those(of: DataFrame) -> DataFrame:
        return rows.join(of, F.col("doc_id").eqNullSafe(F.col("copy_id")) & (sha == F.col("copy_sha")), "left_semi")

    repeats = kept.where("copy_n > 1")
    once = those(kept.where("copy_n = 1"))
    return back(once.unionByName(those(repeats).withColumn("copy_sha", sha).dropDuplicates(["doc_id", "copy_sha"]).drop("copy_sha")))
