"""Mix sources to target word counts by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import WORD, fresh, stored, whole_text

MOST_COPIES = 2
BUCKETS = 4096


def word_count(text: str | Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def uniform(id_col: str, text_col: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only (on the text where the id is null)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(whole_text(text_col).cast("binary"))))
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 12)
    return (F.conv(hexes, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sized: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """Target words per source: source, source_size, target.

    Sources in code point order, null last, get the weights in turn. ``share`` times all words are dealt by weight;
    a source stops at ``MOST_COPIES`` times its size and its excess is dealt to the others. That ends at one level
    theta with target = min(cap, theta * weight), found by going through the sources by cap / weight.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # The windows below see one row per source, never documents.
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_COPIES))
    ratio = F.col("cap") / F.col("weight")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    goal = F.sum("source_size").over(everything) * float(share)
    left = goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if this source and all after it were open. It is right for the first source that stays below its cap.
    level = left / open_weight
    sources = sources.withColumn("level", F.when(level <= ratio, level))
    theta = F.min_by("level", F.when(F.col("level").isNotNull(), ratio)).over(everything)
    target = F.when(theta.isNull(), F.col("cap")).otherwise(F.least("cap", theta * F.col("weight")))
    return sources.select("source", "source_size", target.alias("target"))


def _inclusion_scale(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds whole (copies every document gets), rest (words still to draw) and scale: inclusion is min(1, scale * size)
    with an expected number of words of rest. Works on distinct sizes per source, whose number long texts bound."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sizes = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).drop(targets.source)
    larger = Window.partitionBy("source").orderBy(F.col("size").desc())
    above = larger.rowsBetween(Window.unboundedPreceding, -1)
    onward = larger.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    words, squares = F.col("n") * F.col("size"), F.col("n") * F.col("size").cast("double") * F.col("size")
    # With all larger sizes certain, the scale for this size and the smaller ones.
    scale = (F.col("rest") - F.coalesce(F.sum(words).over(above), F.lit(0))) / F.sum(squares).over(onward)
    # The largest size that is not certain decides.
    fits = sizes.withColumn("scale", scale).filter("scale >= 0 AND scale * size <= 1")
    best = fits.groupBy("source").agg(F.max_by("scale", "size").alias("scale"))
    out = targets.join(best, targets.source.eqNullSafe(best.source), "left").drop(best.source)
    # No size fits only where rest is all of the source by rounding: everything is certain.
    return out.withColumn("scale", F.coalesce("scale", F.when(F.col("rest") > 0, F.lit(1.0)).otherwise(F.lit(0.0))))


def _ranked(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with their source's plan and Pareto rank: random odds over inclusion odds, 0 if certain."""
    own = sized.join(plan, sized.source.eqNullSafe(plan.source), "left").drop(plan.source)
    pi = F.least(F.lit(1.0), F.col("scale") * F.col("size"))
    odds = F.col("u") / (1.0 - F.col("u"))
    rank = F.when(pi >= 1.0, F.lit(0.0)).when(pi > 0, odds * ((1.0 - pi) / pi))
    return own.withColumn("rank", rank)


def mix_plan(sized: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """One row per source: source, source_size, target, whole, scale, and the last (rank, u) that the draw takes.

    ``sized`` has source, size and u. Documents of a source are taken by ascending rank while the words so far and half
    the next document stay within rest, so a source misses its target by half a document at most (rows with one
    rank and u, that is one id, go together). The running sum over a source is never one task: words are first
    summed per rank bucket, and only the bucket in which the draw ends is ordered.
    """
    targets = stored(source_targets(sized, weights, share), "mix-targets")
    plan = stored(_inclusion_scale(sized, targets), "mix-scale")
    bucket = F.when(F.col("rank") == 0, F.lit(-1)).otherwise(F.floor(F.col("rank") / (1.0 + F.col("rank")) * BUCKETS))
    ranked = _ranked(sized, plan).filter("rank IS NOT NULL").withColumn("bucket", bucket)
    sums = stored(ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    sums = sums.join(plan.select("source", "rest"), sums.source.eqNullSafe(plan.source)).drop(plan.source)
    ends = sums.filter("before <= rest").groupBy("source").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("end"))
    inside = ranked.join(ends, ranked.source.eqNullSafe(ends.source)).drop(ends.source)
    inside = inside.filter(F.col("bucket") == F.col("end.bucket"))
    order = Window.partitionBy("source").orderBy("rank", "u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Words up to and with this row and its equals, less half of this row.
    upto = F.col("end.before") + F.sum("size").over(order) - F.col("size") / 2
    cut = inside.withColumn("upto", upto).groupBy("source", "end").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("rank", "u"))).alias("last")
    )
    cut = cut.select("source", F.col("end.bucket").alias("end_bucket"), "last")
    out = plan.join(cut, plan.source.eqNullSafe(cut.source), "left").drop(cut.source)
    return stored(out.select("source", "source_size", "target", "whole", "scale", "end_bucket", "last"), "mix-plan")


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (source, size, u and any more columns) with source_size, target and the number of copies taken."""
    rows = _ranked(sized, plan)
    bucket = F.when(F.col("rank") == 0, F.lit(-1)).otherwise(F.floor(F.col("rank") / (1.0 + F.col("rank")) * BUCKETS))
    drawn = F.col("rank").isNotNull() & F.col("end_bucket").isNotNull()
    drawn &= (bucket < F.col("end_bucket")) | (
        (bucket == F.col("end_bucket")) & F.col("last").isNotNull() & (F.struct("rank", "u") <= F.col("last"))
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(drawn, 1).otherwise(0)).otherwise(F.lit(0))
    return rows.withColumn("copies", copies.cast("long")).drop("whole", "scale", "end_bucket", "last", "rank", "u")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Size, source_size, target and copies per document: columns id, size, source_size, target, copies.

    Every document first gets its certain whole copies (target over source size, rounded down); the words still
    missing are drawn by Pareto order sampling with inclusion proportional to size. No document gets more than two
    copies. Null and empty texts have size 0 and are never taken; a null source is one source, last in order;
    rows of one id are taken or left together; an empty table gives no rows. Reruns agree: chance comes from
    the id. Weights repeat over the sources.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
            uniform(id_col, text_col, seed).alias("u"),
        ),
        "mix-sized",
    )
    taken = with_copies(sized, mix_plan(sized, weights, share))
    return taken.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies")


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs`` (doc_id, text, source and more), each as often as ``mix_sources`` takes it.

    Null and empty texts have no words, so nothing asks for them; a null source is a source of its own; repeated rows each
    have their share; other columns, whatever their names, are unchanged; an empty table gives an empty mix.
    """
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col("source").cast("string").alias("source"),
        word_count("text").alias("size"),
        uniform("doc_id", "text", seed).alias("u"),
    )
    sized = stored(packed.drop("row"), "mix-sized")
    taken = with_copies(packed, mix_plan(sized, weights, share)).filter("copies > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(fresh("copy", names)))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in names])
