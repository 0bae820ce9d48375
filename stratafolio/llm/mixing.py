"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.llm._shared import written

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Above this many sources the plan is joined by a shuffle. 100,000 rows of a name and four numbers are some 10 MB.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) with 52 bits, from MD5 of the seed, the id and the text's MD5: the same in every run and on every cluster.

    The text tells rows without an id, or with the same one, apart; rows that agree in both share a draw.
    """
    own = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, max_repeats: float = 3.0) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight): the total size shared by weight, no source above
    ``max_repeats`` times its size, the excess reshared by weight until none is above.

    In the order of cap / weight the capped sources come first, so the running sums over that order give the fixed point at
    once instead of round by round. One row per source goes into the one window partition: a mixture's sources, not documents.
    A source without weight, or of size 0, gets 0.
    """
    cap = F.col("source_size") * F.lit(float(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weighed = (
        sizes.withColumn("weight", F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap", cap)
        .filter(F.col("weight") > 0)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("capped", F.col("weight") * F.col("left") > F.col("cap") * F.col("open_weight"))
        .withColumn("capped_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - F.col("capped_sum")) / F.col("free_weight")),
        )
    )
    return sizes.join(weighed.select(F.col("source").alias("source_"), "target"), F.col("source").eqNullSafe(F.col("source_")), "left").select(
        *sizes.columns, F.coalesce("target", F.lit(0.0)).alias("target")
    )


def ranked_weights(sizes: DataFrame, cycle: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Adds ``weight``: the sources in code point order, null last, take the weights of ``cycle`` in turn."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int")))


def rates(docs: DataFrame, weights: DataFrame | None = None, *, text_col: str = "text", source_col: str = "source", max_repeats: float = 3.0) -> DataFrame:
    """source, source_size, target and rate, a row per source, written to the shared folder."""
    words = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sizes = ranked_weights(sizes)
    else:
        named = weights.select(F.col("source").alias("source_"), "weight")
        sizes = sizes.join(named, F.col("source").eqNullSafe(F.col("source_")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    return written(targets(sizes, max_repeats).select("source", "source_size", "target", rate.alias("rate")), "mix-sources")


def mix_plan(
    docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_repeats: float = 3.0, seed: int = 42,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken (copies * size).

    ``weights`` has (source, weight); without it the weights 5, 2, 1 repeat over the sources in order. A document is taken
    floor(rate) times, rate = target / source_size, and once more if its hash-seeded number lies below the fraction.
    Null and empty texts have size 0; a null source is a source of its own; rows that agree in doc_id and text share one draw; an empty
    table gives an empty plan. Only the columns named are read, so others may have any names.

    Per-source sums are partially aggregated before they are shuffled, so a source with most of the rows costs no more; the
    table of sources is broadcast only if counted to be small, else joined by a shuffle that AQE may split.
    """
    words = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), uniform(seed, F.col(id_col), F.col(text_col)).alias("draw")
    )
    plan = rates(docs, weights, text_col=text_col, source_col=source_col, max_repeats=max_repeats)
    small = plan.count() <= BROADCAST_SOURCES
    named = plan.select(F.col("source").alias("source_"), "source_size", "target", "rate")
    joined = words.join(F.broadcast(named) if small else named.hint("merge"), F.col("source").eqNullSafe(F.col("source_")), "inner").drop("source_")
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("draw")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float = 3.0, seed: int = 42) -> DataFrame:
    """The documents themselves, each row as often as its plan says, with all columns of ``docs`` and no others.

    The plan's rate depends on the source alone, so it is joined by source and the text is not shuffled. Nulls, ties, repeated rows
    and empty tables as in :func:`mix_plan`.
    """
    plan = rates(docs, weights, text_col=text_col, source_col=source_col, max_repeats=max_repeats)
    small = plan.count() <= BROADCAST_SOURCES
    named = plan.select(F.col("source").alias("__sf_source"), F.col("rate").alias("__sf_rate"))
    joined = docs.join(F.broadcast(named) if small else named.hint("merge"), F.col(source_col).eqNullSafe(F.col("__sf_source")), "inner")
    rate = F.col("__sf_rate")
    copies = (F.floor(rate) + (uniform(seed, F.col(id_col), F.col(text_col)) < rate - F.floor(rate)).cast("long")).cast("int")
    repeated = joined.withColumn("__sf_copies", copies).filter("__sf_copies > 0").withColumn("__sf_copy", F.explode(F.expr("sequence(1, __sf_copies)")))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
