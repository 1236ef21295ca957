"""Mix sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis), in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_name, settle, unit_uniform

#: Rows that share a bucket of keys; only one bucket of each source is sorted.
BUCKET_ROWS = 20_000
# Fixed value: what separates words.
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def plain_quality(text: Column) -> Column:
    """Quality weight of a text without a classifier: 1 where words have 3 to 12 characters on average with their spaces, else 1/4."""
    mean = F.length(text) / F.greatest(n_words(text), F.lit(1))
    return F.when(mean.between(3, 13), 1.0).otherwise(0.25)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows): ``share`` of all words dealt by weight, no target above ``most`` times its source.

    Sources in order of code points, null last, take the weights in turn. What a capped source leaves is dealt to the others by
    weight until none is above its cap: with sources in order of cap / weight this ends where the level (rest of the words / rest of the
    weights) no longer reaches the next cap. One row per source, so windows over the whole table are small; weights are positive.
    """
    if not weights or min(weights) <= 0 or not 0 < share <= most:
        raise ValueError("weights must be positive, and share positive and no larger than most")
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights)).cast("int") + 1)
    rows = sizes.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "turn")
    whole, before, after = W.partitionBy(), order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    rows = rows.withColumn("final", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "turn", "level"))).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return rows.select("source", "source_size", "rows", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    quality: Column | None = None,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(key, source, size, source_size, target, taken, copies) for every row of ``docs``.

    A source whose target is e times its size plus a rest takes each document e times (complete epochs) and then documents in order of
    -ln(u) / quality, u a uniform number from key and seed, until the rest is reached; the document at the limit gives its first words only.
    ``taken`` counts words over all takes, ``copies`` the documents' appearances (the cut one counts as whole).
    ``quality`` is a positive Column over ``docs``, ``plain_quality`` of the text if not given.

    The order within a source is never sorted as a whole. Keys fall into buckets of about ``BUCKET_ROWS`` rows by value; prefix sums over
    buckets find the one in which the limit lies, and only its rows are sorted. A source with most of the rows costs no more per task.
    The text is read once; the narrow rows go to the scratch folder.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Null key: one value like any other. Repeated rows are
    rows of their own, ordered by size where key and order tie. An empty table gives an empty result. Other columns are not looked at.
    """
    weight = plain_quality(F.col(f"`{text}`")) if quality is None else quality
    order = -F.log(unit_uniform(F.col(f"`{key}`"), seed=seed)) / weight.cast("double")
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), order.alias("order")
    )
    rows = settle(narrow, "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target")).cast("bigint") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("buckets", F.ceil(F.col("rows") / F.lit(BUCKET_ROWS)).cast("bigint"))
    plan = settle(plan, "mix-plan").withColumnRenamed("source", "of")

    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bucket = F.least(F.floor(F.col("buckets") * (1 - F.exp(-F.col("order")))), F.col("buckets") - 1).cast("bigint")
    placed = placed.withColumn("bucket", bucket)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    up_to = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    # Zero-size rows take nothing wherever the limit lies, so the first bucket that reaches the rest is the one to sort.
    reached = sums.withColumn("up_to", up_to).where((F.col("up_to") >= F.col("rest")) & (F.col("up_to") - F.col("words") < F.col("rest")))
    limit = settle(reached.select(F.col("source").alias("of"), F.col("bucket").alias("at"), (F.col("up_to") - F.col("words")).alias("before")), "mix-limit")

    rows = placed.join(limit, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    inside = F.col("bucket") == F.col("at")
    w = W.partitionBy("source").orderBy("order", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    sorted_part = rows.where(inside).withColumn("earlier", F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    sorted_part = sorted_part.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("earlier"))))
    others = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("bucket") < F.col("at"), F.col("size")).otherwise(F.lit(0)))
    result = others.unionByName(sorted_part.drop("earlier"))
    copies = F.col("epochs") + (F.col("extra") > 0).cast("bigint")
    return result.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
        F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("bigint").alias("copies"),
    )


def repeat_documents(docs: DataFrame, mix: DataFrame, key: str = "doc_id", size: str = "size") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all their columns kept; a document at a limit stays whole.

    Rows that share a key take that key's copies in turn of no particular order: the copies of a key are dealt to its distinct rows evenly.
    """
    of, copies, rows, take = (fresh_name(docs, name) for name in ("of_key", "copies_of", "rows_of", "take_no"))
    per_key = mix.groupBy(F.col(f"`{key}`").alias(of)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    names = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(per_key, F.col(f"`{key}`").eqNullSafe(F.col(of))).where(F.col(copies) > 0)
    times = F.ceil(F.col(copies) / F.col(rows)).cast("int")
    return joined.withColumn(take, F.explode(F.sequence(F.lit(1), times))).select(*names)
