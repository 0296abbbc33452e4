"""How corpus filters act on one another: what each step removes in every order in which they can be applied."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filters on one text, by their letters; the copies' filter comes after them.
TEXT_FILTERS = "ABCD"
COPIES = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter: A, under 200 words; B, fewer than half of its words are different; C, over 2 % of
    its characters are capital letters; D, it holds one of #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, different, chars = F.size(words), F.size(F.array_distinct(words)), F.char_length(text)
    return {
        "A": n < 200,
        "B": F.lit(100) * different < F.lit(50) * n,
        "C": F.lit(100) * (chars - F.char_length(F.translate(text, CAPITALS, ""))) > F.lit(2) * chars,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", key: str = "doc_id") -> DataFrame:
    """Documents counted by part and mask: columns part, mask (bit i is set if the i-th of ABCDE fails), n, good, toxic.

    Filter E fails a text that a row with a smaller key has too, anywhere in the table. Null texts count as empty ones and
    null parts as ''. A row with a null key has no smaller one and is no smaller one. Of several labels of a key any
    quality = 1 makes it good and any toxic = 1 toxic.

    Texts don't move: they are known by 256-bit digests. Rows are counted by digest and part before the smallest key
    of a digest is looked for, so a text with a third of all rows is as many rows there as it has parts and labels.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(body).values())), F.lit(0))
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    told = slim.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = told.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    keyed = F.col("id").isNotNull()
    groups = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(keyed, 0).otherwise(F.col("n"))).alias("unkeyed"), F.min(F.when(keyed, F.struct("id", "n"))).alias("first"))
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    stays = F.col("unkeyed") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct("mask", stays.alias("n")), F.struct((F.col("mask") + (1 << len(TEXT_FILTERS))).alias("mask"), (F.col("n") - stays).alias("n")))
    cells = groups.withColumn("smallest", smallest).select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def interactions(cells: DataFrame, filters: Sequence[str] = TEXT_FILTERS + COPIES) -> DataFrame:
    """One row for each part, order of the filters and step, zeros too: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley (what the step's filter removes, summed over all orders).

    cells: part, mask, n, good, toxic, at most one row for each part and mask; an empty table gives no rows. Every cell is
    laid out against the steps of every order; a running bit-or over its earlier steps tells whether it is already gone.
    One exchange by part and order serves that window and the sums.
    """
    if len(set(filters)) != len(filters) or any(len(f) != 1 for f in filters):
        raise ValueError("filters are different letters")
    letters, size = "".join(filters), len(filters)
    orders = ",".join("".join(p) for p in permutations(letters))
    laid = cells.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    laid = laid.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    laid = laid.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', filter) - 1)")).withColumn("hit", F.col("mask").cast("int").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = laid.repartition("part", "filter_order").withColumn("gone", F.coalesce(F.bit_or("hit").over(earlier), F.lit(0)) != 0)
    fails, gone = F.col("hit") != 0, F.col("gone")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long").alias
    sums = seen.groupBy("part", "filter_order", "step", "filter").agg(
        total(~gone & ~fails, "n")("kept"),
        total(~gone & fails, "n")("removed"),
        total(gone & fails, "n")("redundant"),
        total(F.col("mask") == F.col("bit"), "n")("unique_fails"),
        total(~gone & fails, "good")("good_lost"),
        total(~gone & fails, "toxic")("toxic_lost"),
    )
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", key: str = "doc_id") -> DataFrame:
    """`interactions` of the five filters over the documents; see `failure_cells` for what counts as what."""
    return interactions(failure_cells(docs, labels, text, part, key))
