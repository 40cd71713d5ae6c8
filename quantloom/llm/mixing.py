"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, one_by_one, stage

PASSES = 3
WEIGHTS = (1, 2, 3)
MOST_BUCKETS, CHUNK = 4_096, 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source, source_size, target from (source, source_size), a row a source.

    Sources in code point order, null last, get the weights in turn. All sizes
    together are shared out by weight; a share stops at passes times its
    source's size and the excess goes to the others by weight, until none is
    above. In closed form: sources fill up in the order of size over weight, so
    the level is fixed by the first source, in that order, that does not fill.
    Its windows hold a row a source, of a few dozen bytes.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(passes))
    by_fill = W.orderBy(full / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    # the level is set by the first source that it does not fill
    held = level.withColumn("level", F.min(F.when(F.col("level") <= full / F.col("weight"), F.struct(full / F.col("weight"), F.col("level"))))
                            .over(everything).getField("level"))
    return held.select("source", "source_size", F.least(full, F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], size: str, out: str, buckets: int) -> DataFrame:
    """df with out: the sum of size up to and with each row, by keys in order.

    Buckets, about `buckets` of them a key, are ranges of the order. Their sums
    are summed first, in the same way where they are many, so no window holds
    more than one bucket's rows, or MOST_BUCKETS sums, and one key may hold most
    rows.
    """
    cut = df.withColumn("bucket", bucket)
    sums = cut.groupBy(*keys, "bucket").agg(F.sum(size).alias("sum"))
    if buckets > MOST_BUCKETS:
        summed = running(sums.withColumnRenamed("bucket", "part"), keys, F.floor(F.col("part") / MOST_BUCKETS), [F.col("part")], "sum", "upto", buckets // MOST_BUCKETS + 1)
        sums = summed.select(*keys, F.col("part").alias("bucket"), (F.col("upto") - F.col("sum")).alias("before"))
    else:
        lead = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select(*keys, "bucket", F.coalesce(F.sum("sum").over(lead), F.lit(0)).alias("before"))
    same = [cut[k].eqNullSafe(sums[k]) for k in [*keys, "bucket"]]
    within = W.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = cut.join(sums, [x for x in same], "inner").select(cut["*"], sums["before"])
    return joined.withColumn(out, F.col("before") + F.sum(size).over(within)).drop("bucket", "before")


def planned(rows: DataFrame, weights: Sequence[int], passes: int, seed: str, rows_per_bucket: int) -> DataFrame:
    """rows (id, source, size, row) with turn, source_size, target and copies."""
    alike = ["id", "source", "size", "row"]
    # rows alike in all of these are interchangeable: a turn tells them apart
    base = one_by_one(rows.select(*alike), alike)
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.when(F.col("id").isNull() | (F.col("turn") > 0), F.concat_ws(":", "size", "turn")))
    base = stage(base.withColumn("shuffle", F.md5(name)), "sizes")
    sizes = stage(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    targets = source_targets(sizes.select("source", "source_size"), weights, passes)
    known = stage(targets.join(sizes.select(F.col("source").alias("of"), "n"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "targets")
    counts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget")).first()
    spot = F.conv(F.substring("shuffle", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    with_target = base.alias("b").join(known.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.target", "t.n")
    own = F.floor(spot * F.ceil(F.col("n") / rows_per_bucket))
    tie = [F.col(c) for c in ("id", "size", "row", "turn")]
    queued = running(with_target, ["source"], own, [F.col("shuffle"), *tie], "size", "upto", counts["n"] // rows_per_bucket + 1).drop("n")
    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")).otherwise(F.lit(0.0)))
    # at virtual time 1 each source has its target, and the targets fill the budget
    parts = max(1, counts["n"] * passes // rows_per_bucket)
    late = F.when(F.col("finish") <= 1, F.floor(F.col("finish") * parts)).otherwise(parts + F.floor(F.ln("finish") * parts))
    cut = running(copies.where("size > 0"), [], late, [F.col("finish"), F.col("source"), F.col("id"), F.col("size"), F.col("pass"), F.col("row"), F.col("turn")], "size", "line", 3 * parts)
    taken = cut.where(F.col("line") <= F.lit(counts["budget"])).groupBy(*alike, "turn").agg(F.count("*").alias("copies"))
    same = F.lit(True)
    for c in [*alike, "turn"]:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}"))
    return with_target.alias("b").join(taken.alias("k"), same, "left").select("b.id", "b.source", "b.size", "b.row", "b.turn", "b.source_size", "b.target", F.coalesce(F.col("k.copies"), F.lit(0)).alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES, seed: str = "mix", rows_per_bucket: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: a row a document.

    A document's size is its number of words. Each source is shuffled by a
    hash of doc_id and queued up to `passes` times; a copy's virtual finish time
    is the source's cumulative words up to it over the source's target. All
    copies are ordered by finish time across sources, and the mix is that order
    up to the total budget (all sizes together).

    Null or empty texts have size 0 and are taken 0 words. A null source is a
    source of its own. Rows that repeat, also with one doc_id or none, are queued
    each, told apart by their turn among those alike. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"), F.lit(0).alias("row"))
    found = planned(rows, weights, passes, seed, rows_per_bucket)
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES, seed: str = "mix", rows_per_bucket: int = 4096) -> DataFrame:
    """docs with their columns, of any names, each row as often as the mix takes it.

    Null and empty texts have size 0 and aren't taken. Rows equal in all columns
    are told apart by their turn in the mix and come out as often, together, as
    it takes them. An empty table gives none.
    """
    cells = [f(F.col(f"`{c}`")) for c in docs.columns for f in (F.isnull, lambda x: x)]
    # the caller's columns are one struct, so that no name can clash
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b")).alias("row"))
    rows = own.select(F.col("whole.doc_id").alias("id"), F.col("whole.source").alias("source"), word_count(F.col("whole.text")).alias("size"), "row")
    plan = stage(planned(rows, weights, passes, seed, rows_per_bucket).groupBy("row").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("copies > 0"), "mix")
    joined = own.join(plan.hint("merge"), "row")
    each = F.expr("int(copies div n)")
    times = lambda n: F.explode(F.sequence(F.lit(1), n)).alias("time")
    out = joined.where(each > 0).select("whole", times(each)).select("whole.*")
    if plan.where("copies % n > 0").isEmpty():
        return out
    # what is left over among equal rows: of one of them, dealt out in chunks
    rest = joined.where("copies % n > 0").groupBy("row").agg(F.first("whole").alias("whole"), F.first(F.expr("copies % n")).alias("left"))
    chunks = rest.select("row", "whole", "left", F.explode(F.sequence(F.lit(0), ((F.col("left") - 1) / CHUNK).cast("int"))).alias("chunk")).repartition("row", "chunk")
    return out.unionByName(chunks.select("whole", times(F.least(F.lit(CHUNK), F.col("left") - F.col("chunk") * CHUNK).cast("int"))).select("whole.*"))
