"""Filter interaction audit: what each quality filter removes, in every order."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import WORD

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words, percent of words, percent of code points
SYMBOLS = r"[#$%&*|]"
CELL = ["part", "mask", "quality", "toxic"]


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone, A to D; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    mask = F.lit(0)
    for name, condition in failed.items():
        mask = mask.bitwiseOR(F.when(condition, F.lit(bit(name))).otherwise(0))
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, quality, toxic, n: documents counted by which filters they fail.

    A text is known by its SHA-256. Rows alike in all that counts are counted
    where they lie, before any shuffle, and a copy is told from the first of its
    text by the smallest doc_id of each (text, part, labels): so a text that
    stands at a third of all rows is a few rows when its copies meet. Texts
    themselves are never shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), own_failures(F.col("text")).alias("mask"))
    alike = rows.groupBy("doc_id", "same", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("quality"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    # a row without an id has no label and is no copy of a smaller one: it needs neither join nor group
    labelled = alike.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").select("doc_id", "same", "part", "mask", "n", flag("quality"), flag("toxic"))
    first = labelled.groupBy("same", *CELL).agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum("n").alias("n"))
    leads = F.when(F.col("least") == F.min("least").over(W.partitionBy("same")), F.col("n_least")).otherwise(0)
    split = first.withColumn("leads", leads).select(*CELL[:1], *CELL[2:], F.explode(F.array(
        F.struct("mask", F.col("leads").alias("n")),
        F.struct(F.col("mask").bitwiseOR(bit("E")).alias("mask"), (F.col("n") - F.col("leads")).alias("n")),
    )).alias("cell")).select("part", "cell.mask", "quality", "toxic", "cell.n")
    nameless = alike.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(False).alias("quality"), F.lit(False).alias("toxic"), "n")
    return split.where("n > 0").unionByName(nameless).groupBy(*CELL).agg(F.sum("n").alias("n"))


def steps(cells: DataFrame) -> DataFrame:
    """cells, each unpivoted against every step of every order: filter_order, step,
    fails (the bit that it fails there, or 0) and earlier (the running bit-or of
    those before in the order)."""
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    long = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    own = F.element_at(F.create_map(*[x for f in FILTERS for x in (F.lit(f), F.lit(bit(f)))]), F.col("filter"))
    before = W.partitionBy("part", "filter_order", "mask", "quality", "toxic").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    marked = long.select("*", (F.col("at") + 1).cast("int").alias("step"), own.alias("bit")).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    return marked.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and what the filter of that step does to
    the documents of the part: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    Filters: A, under 200 words; B, distinct words under half of all; C, capitals
    over 3 in 100 code points; D, one of the symbols; E, the text of a smaller
    doc_id. Documents are first counted by their mask of failures; the cells are
    unpivoted against the steps of all 120 orders, a running bit-or tells who went
    before, conditional sums count, and a window by filter totals what it removes
    over all orders. The work after one pass over the texts depends on the number
    of parts only.

    A null text is an empty one (it fails A, and E as any copy does), a null lang
    is the part ''. Rows that repeat a doc_id count each; of one text none of those
    with its smallest doc_id fails E. A null doc_id is smaller than none, has none
    smaller, and no label. A label stands if any row of the doc_id says 1. Very
    long texts are read whole. An empty table gives no rows; columns other than
    doc_id, text, lang, and of labels doc_id, quality, toxic, are ignored.
    """
    removed = (F.col("fails") != 0) & (F.col("earlier") == 0)
    counted = lambda condition, name: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)
    found = steps(mask_cells(docs, labels)).groupBy("part", "filter_order", "step", "filter").agg(
        counted((F.col("fails") == 0) & (F.col("earlier") == 0), "kept"),
        counted(removed, "removed"),
        counted((F.col("fails") != 0) & (F.col("earlier") != 0), "redundant"),
        counted((F.col("fails") != 0) & (F.col("mask") == F.col("fails")), "unique_fails"),
        counted(removed & F.col("quality"), "good_lost"),
        counted(removed & F.col("toxic"), "toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))
