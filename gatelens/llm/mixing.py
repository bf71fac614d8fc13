"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is ``target / size of its source``. The whole part of it is certain. For the
rest the source's documents are ranked by their random odds over their inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``,
and taken in this order until the source has its words. With importances the inclusion probability ``p`` differs
within a source; without, between sources only.

No source is ordered as a whole: ranks are counted in bins, running sums over parts of 256 bins and over the bins of a
part find the one in which the target is reached, and only that bin's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import packed, stored, unpacked

BINS = 1 << 16
PART_BITS = 8


def shares(sizes: DataFrame, most: float) -> DataFrame:
    """``_source, _total, _weight`` (one row per source) with ``_target``.

    Targets split the sum of all sizes by weight; none exceeds ``most`` times its source's size, and what is cut off
    is split again among the others until none is above. Sources in the order of size limit over weight: the first
    one that its share of what is left does not fill sets the rate for itself and all after it.
    """
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), "_source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rate = (F.sum("_total").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    )
    rated = sizes.withColumn("_limit", F.col("_total") * F.lit(float(most))).withColumn("_rate", rate)
    free = F.min(F.when(F.col("_rate") * F.col("_weight") < F.col("_limit"), F.struct(F.col("_limit") / F.col("_weight"), "_source", "_rate"))).over(whole)
    return rated.withColumn("_free", free["_rate"]).select(
        "_source",
        "_total",
        F.when(F.col("_free").isNull(), F.col("_limit"))
        .otherwise(F.least(F.col("_limit"), F.col("_free") * F.col("_weight")))
        .alias("_target"),
    )


def _uniform(seed: int, *parts: Column) -> Column:
    """A number between 0 and 1, never either, from a hash of what identifies a row."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def by_code_point(sources: DataFrame, cycle: list[int]) -> DataFrame:
    """Weights for ``_source`` rows: the cycle over the sources by code point, null last. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    return sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def _filled(drawn: DataFrame) -> DataFrame:
    """Adds, for each source, the document left out whose size is closest to what is still missing, if that helps."""
    source = ["_same", "_name"]
    open_ = drawn.filter("_bin IS NOT NULL")
    missing = stored(
        open_.groupBy(*source).agg(
            (F.max(F.col("_rest") * F.col("_total")) - F.sum(F.col("_size") * F.col("_more"))).alias("_missing")
        ),
        "missing",
    )
    off = F.abs(F.col("_size") - F.col("_missing"))
    fill = stored(
        open_.filter("_more = 0")
        .join(missing, source)
        .filter(off < F.abs("_missing"))
        .groupBy(*source)
        .agg(F.min(F.struct(off.alias("off"), "_rank", "_id", "_size")).alias("_fill")),
        "fill",
    )
    matched = drawn.join(fill, source, "left").withColumn(
        "_chosen",
        F.coalesce(
            (F.col("_more") == 0)
            & F.col("_rank").eqNullSafe(F.col("_fill")["_rank"])
            & F.col("_id").eqNullSafe(F.col("_fill")["_id"])
            & (F.col("_size") == F.col("_fill")["_size"])
            & F.col("_fill").isNotNull(),
            F.lit(False),
        ),
    )
    once = Window.partitionBy(*source).orderBy("_rank")
    chosen = matched.filter("_chosen").withColumn("_more", F.when(F.row_number().over(once) == 1, 1).otherwise(0))
    return matched.filter("NOT _chosen").select(*drawn.columns).union(chosen.select(*drawn.columns))


def mix(
    docs: DataFrame,
    size_col: str,
    id_col: str = "doc_id",
    source_col: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    importance: str | None = None,
    seed: int = 20,
) -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, copies, taken``.

    Sources, by code point and null last, weigh ``cycle`` over and over, and share the sum of all sizes; a target
    stops at ``most`` times its source's size (see ``shares``). ``copies`` is how often the mix takes a document
    (0 to ``most``) and ``taken`` that times its size. Documents are taken in the order of their ranks while they fit;
    then the one left out that comes closest to what is missing is added if it brings the source nearer to its target.
    ``importance`` names a column of positive numbers that multiply the
    inclusion odds. Reruns agree: chance is a hash of seed, source, id and size.

    Null or empty text: size 0, taken 0, and never counted against a target. Null source: a source of its own. Null
    ids and repeated rows: rows with equal source, id and size rank alike; the ties at a border are filled one row after
    the other. All sizes zero: all targets zero. Empty input: no rows. Other columns pass through; those named like
    the new ones are replaced.
    """
    rows = packed(
        docs,
        _source=docs[source_col],
        _id=docs[id_col],
        _size=F.coalesce(docs[size_col].cast("long"), F.lit(0).cast("long")),
        _odds=F.lit(1.0) if importance is None else F.coalesce(docs[importance].cast("double"), F.lit(1.0)),
    )
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("_total"))
    targets = stored(shares(by_code_point(totals, list(cycle)), most), "targets")
    ratio = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0)
    targets = targets.withColumn("_ratio", ratio).withColumn("_sure", F.floor("_ratio"))
    targets = targets.withColumn("_rest", F.col("_ratio") - F.col("_sure"))

    known = rows.withColumn("_same", F.col("_source").isNull()).withColumn("_name", F.coalesce("_source", F.lit("")))
    targets = targets.select(
        F.col("_source").isNull().alias("_same"), F.coalesce("_source", F.lit("")).alias("_name"),
        "_total", "_target", "_ratio", "_sure", "_rest",
    )
    known = known.join(targets, ["_same", "_name"])
    u = _uniform(seed, F.col("_source"), F.col("_id"), F.col("_size"))
    odds = F.col("_rest") / (1 - F.col("_rest")) * F.col("_odds")
    rank = (u / (1 - u)) / odds
    ranked = known.withColumn("_rank", F.when((F.col("_rest") > 0) & (F.col("_size") > 0), rank))
    ranked = ranked.withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS).cast("int"))

    source = ["_same", "_name"]
    bins = stored(
        ranked.filter("_bin IS NOT NULL")
        .groupBy(*source, "_bin")
        .agg(F.sum("_size").alias("_words"), F.max(F.col("_rest") * F.col("_total")).alias("_wanted")),
        "bins",
    ).withColumn("_part", F.shiftright("_bin", PART_BITS))
    earlier = Window.partitionBy(*source).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        bins.groupBy(*source, "_part")
        .agg(F.sum("_words").alias("_in_part"))
        .withColumn("_earlier", F.coalesce(F.sum("_in_part").over(earlier), F.lit(0)))
    )
    upto = Window.partitionBy(*source, "_part").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.join(parts, [*source, "_part"]).withColumn("_upto", F.col("_earlier") + F.sum("_words").over(upto))
    border = stored(
        bins.filter("_upto >= _wanted")
        .groupBy(*source)
        .agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("_before"), "_wanted")).alias("_first"))
        .select(*source, F.col("_first._bin").alias("_border"), "_first._before", "_first._wanted"),
        "border",
    )
    placed = ranked.join(border, ["_same", "_name"], "left")
    at_border = F.col("_bin").eqNullSafe(F.col("_border")) & F.col("_bin").isNotNull()
    clear = placed.filter(~at_border).withColumn(
        "_more", F.when(F.col("_bin").isNotNull() & (F.col("_border").isNull() | (F.col("_bin") < F.col("_border"))), 1).otherwise(0)
    )
    in_order = Window.partitionBy("_same", "_name").orderBy("_rank", "_id").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("_before") + F.sum("_size").over(in_order)
    close = placed.filter(at_border).withColumn("_reached", reached)
    close = close.withColumn("_more", F.when(F.col("_reached") <= F.col("_wanted"), 1).otherwise(0)).drop("_reached")
    drawn = clear.union(close.select(*clear.columns))
    judged = _filled(drawn)
    copies = F.when(F.col("_size") > 0, F.col("_sure") + F.col("_more")).otherwise(0).cast("long")
    return unpacked(
        judged,
        docs.columns,
        size=F.col("_size"),
        source_size=F.col("_total"),
        target=F.col("_target"),
        copies=copies,
        taken=copies * F.col("_size"),
    )


def mixed(docs: DataFrame, size_col: str, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was taken, with its columns."""
    id_col, source_col = options.pop("id_col", "doc_id"), options.pop("source_col", "source")
    importance = options.pop("importance", None)
    needed = {"size": docs[size_col], "id": docs[id_col], "source": docs[source_col]}
    if importance:
        needed["importance"] = docs[importance]
    taken = mix(
        packed(docs, **needed), "size", "id", "source", importance="importance" if importance else None, **options
    )
    repeats = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return unpacked(taken.select("_row", F.explode(repeats).alias("_copy")), docs.columns)
