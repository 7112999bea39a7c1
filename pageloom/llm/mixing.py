"""Mixing sources to target weights by weighted fair queueing.

Within each source the documents are shuffled by a hash; a document's virtual
finish time is the source's tokens up to and including it, divided by the
source's target. Repeats of a source follow its first pass. Sorted by finish
time over all sources, any prefix of the mix holds the sources in the ratio of
their targets; it is truncated where the budget is used up.

Running sums never need a source or the whole mix in one task: each is cut into
bands (of the hash, of ranges of the sorted mix), summed inside, and shifted by
the sums of the bands before it. Rows alike in id, text and source are one node
with a count until they are queued, so they are never a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import staged

#: Rows of a band of shuffle order, about; equal rows that one task writes out.
BAND_ROWS = 20_000
#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Budget as a share of all sizes; most that a source is repeated.
SHARE = 1.5
REPEATS = 2
#: What the shuffle's hash starts with.
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def shuffle_key(id_col: Column, text: Column) -> Column:
    """Place of a document in its source's shuffled order, as hexadecimal digits.

    A mark behind them tells a null id from one called null.
    """
    parts = [F.lit(SEED), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))]
    return F.concat(F.md5(F.concat_ws(":", *parts)), F.when(id_col.isNull(), "n").otherwise(""))


def source_key(source: Column) -> Column:
    """The source as a key that is never null; null sorts apart from any name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def rank_sources(sources: DataFrame) -> DataFrame:
    """Sources with their place ``__rank`` from 0 by code point, null last.

    There may be as many sources as documents: they are range-sorted, numbered
    inside their range, and shifted by the sizes of the ranges before it.
    """
    order = F.col("__source").asc_nulls_last()
    ranged = staged(
        sources.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "mix-ranges"
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return (
        ranged.withColumn("__inside", inside)
        .join(offsets, "__range")
        .select("__source", "__source_size", (F.col("__inside") + F.col("__offset") - 1).alias("__rank"))
    )


def targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """``(__source, __source_size, __target)`` of distinct sources with their sizes.

    The budget, ``share`` of all sizes, is shared by weight; what a source can't
    take beyond ``repeats`` times its size is shared again among the others
    until none is above. Each round is one aggregate over the sources.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = staged(
        rank_sources(sources)
        .withColumn("__weight", F.get(cycle, F.pmod("__rank", F.lit(len(weights))).cast("int")))
        .withColumn("__cap", F.col("__source_size") * F.lit(repeats)),
        "mix-sources",
    )
    total = ranked.agg(F.sum("__source_size")).first()[0] or 0
    budget = share * total
    level = None
    while True:
        # A source whose cap is reached at the level so far keeps its cap.
        full = F.lit(False) if level is None else F.col("__cap") <= F.lit(level) * F.col("__weight")
        capped, free = ranked.agg(
            F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("__weight")))
        ).first()
        if not free:
            break
        raised = (budget - float(capped or 0)) / float(free)
        if level is not None and raised <= level:
            break
        level = raised
    target = F.least(
        F.col("__cap").cast("double"), F.lit(float(level or 0.0)) * F.col("__weight")
    )
    return ranked.select("__source", "__source_size", target.alias("__target"))


def running_sum(df: DataFrame, group: Sequence[str], band: str, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over a group's rows up to and including each row.

    ``band`` orders like ``order`` and cuts each group; only band totals cross bands.
    """
    rows = Window.partitionBy(*group, band).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(band).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, band)
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        .drop("__sum")
    )
    return (
        df.withColumn("__inside", F.sum(value).over(rows))
        .join(offsets, [*group, band])
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .drop("__inside", "__offset")
    )


def _bits(rows: int) -> int:
    return max(0, (max(rows, 1) // BAND_ROWS).bit_length())


NODE = ("__group", "__key")


def written_out(nodes: DataFrame) -> DataFrame:
    """``nodes`` with one row per ``__twin`` from 1 to ``__times``.

    A node of more than ``BAND_ROWS`` twins is cut into chunks that are dealt to
    the tasks before they are written out.
    """
    few, many = (nodes.filter(F.col("__times") <= BAND_ROWS), nodes.filter(F.col("__times") > BAND_ROWS))
    first = F.sequence(F.lit(1).cast("bigint"), F.col("__times"), F.lit(BAND_ROWS).cast("bigint"))
    last = F.least(F.col("__times"), F.col("__first") + BAND_ROWS - 1)
    dealt = (
        many.withColumn("__first", F.explode(first))
        .repartition(*NODE, "__first")
        .withColumn("__twin", F.explode(F.sequence("__first", last)))
        .drop("__first")
    )
    return few.withColumn("__twin", F.explode(F.sequence(F.lit(1).cast("bigint"), "__times"))).unionByName(dealt)


def queued(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: Sequence[int],
    share: float,
    repeats: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, order, takes)`` of a mix, as tables.

    ``nodes``: documents alike in id, text and source, ``__times`` of them.
    ``order``: the copies taken. ``takes``: for each node of which the mix takes
    any, ``__takes``, the twins taken at each repeat. Twins queue by number, so
    a repeat that is taken in part takes the first of them.
    """
    read = staged(
        docs.select(
            F.col(id_col).alias("__id"),
            F.col(source_col).cast("string").alias("__source"),
            word_count(F.col(text_col)).alias("__size"),
            shuffle_key(F.col(id_col), F.col(text_col)).alias("__key"),
        )
        .groupBy("__key", "__source")
        .agg(F.min("__id").alias("__id"), F.min("__size").alias("__size"), F.count(F.lit(1)).alias("__times"))
        .withColumn("__words", F.col("__size") * F.col("__times")),
        "mix-sizes",
    )
    sized = read.groupBy("__source").agg(F.sum("__words").alias("__source_size"))
    goal = staged(targets(sized, weights, share, repeats), "mix-targets")
    digits = -(-_bits(read.count()) // 4)
    banded = read.select(
        "*",
        F.substring("__key", 1, digits).alias("__band"),
        source_key(F.col("__source")).alias("__group"),
    )
    summed = running_sum(banded, ["__group"], "__band", [F.col("__key")], "__words", "__sum_to").alias("d")
    nodes = staged(
        summed.join(goal.alias("g"), F.expr("d.__source <=> g.__source")).select(
            "__id", *NODE, "__times", "__size", "__source_size", "__target", "__sum_to"
        ),
        "mix-placed",
    )
    # Words of the source up to and including a twin, the same for each repeat.
    upto = F.col("__sum_to") - (F.col("__times") - F.col("__twin")) * F.col("__size")
    items = (
        written_out(nodes.filter("__size > 0 and __target > 0"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn(
            "__finish", (upto + F.col("__copy") * F.col("__source_size")).cast("double") / F.col("__target")
        )
        .select("__id", *NODE, "__twin", "__copy", "__size", "__finish")
    )
    queue = [F.col(c) for c in ("__finish", *NODE, "__twin", "__copy")]
    # Ranges of the sorted mix hold equal numbers of rows whatever their sizes.
    ranged = staged(
        items.repartitionByRange(*queue).select(
            "*", F.spark_partition_id().alias("__range"), F.lit(0).alias("__all")
        ),
        "mix-ranged",
    )
    budget = share * (read.agg(F.sum("__words")).first()[0] or 0)
    positioned = running_sum(ranged, ["__all"], "__range", queue, "__size", "position")
    order = staged(
        positioned.filter(F.col("position") <= F.lit(budget)).drop("__all", "__range"), "mix-order"
    )
    taken = F.array(*(F.count_if(F.col("__copy") == c) for c in range(repeats)))
    return nodes, order, order.groupBy(*NODE).agg(taken.alias("__takes"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> tuple[DataFrame, DataFrame]:
    """The plan of a mix: ``(rows, order)``.

    ``rows`` has one row per document: ``id_col``, ``size`` in words,
    ``source_size``, ``target`` of its source, ``taken`` words and ``copies``.
    ``order`` lists the taken copies by ``position``, the words of the mix up to
    and including the copy, with ``id_col, copy, finish``.

    Null texts have no words; a document without words is in no mix. Null
    sources form the last source. Repeated rows are documents of their own and
    follow each other; a null id takes part like any other. Other columns are
    ignored. A copy that would cross the budget ends the mix and is left out,
    so the mix is short of the budget by less than one document.
    """
    nodes, order, takes = queued(docs, id_col, text_col, source_col, weights, share, repeats)
    rows = written_out(nodes.join(takes, [*NODE], "left")).withColumn(
        "copies", F.coalesce(copies_of(F.col("__twin")), F.lit(0))
    )
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("copies") * F.col("__size")).cast("bigint").alias("taken"),
        "copies",
    ), order.select(
        F.col("__id").alias(id_col),
        F.col("__copy").alias("copy"),
        F.col("__finish").alias("finish"),
        "position",
    )


def copies_of(twin: Column) -> Column:
    """How often the mix takes the twin of a number, by its node's ``__takes``."""
    return F.size(F.filter("__takes", lambda taken: taken >= twin))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, columns as before.

    Nulls, empty texts and repeated rows as in ``mix``. Rows alike in id, text
    and source are mostly taken equally often. Where the end of the mix falls
    between them they are numbered: inside the parts in which they were read,
    shifted by the rows of the parts before.
    """
    nodes, _, takes = queued(docs, id_col, text_col, source_col, weights, share, repeats)
    plan = staged(nodes.select(*NODE, "__times").join(takes, [*NODE]), "mix-plan")
    whole = F.forall("__takes", lambda taken: (taken == 0) | (taken == F.col("__times")))
    keyed = docs.withColumn("__group", source_key(F.col(source_col))).withColumn(
        "__key", shuffle_key(F.col(id_col), F.col(text_col))
    )

    def repeated(rows: DataFrame, twin: Column) -> DataFrame:
        times = F.array_repeat(F.lit(0), copies_of(twin))
        return rows.withColumn("__copy", F.explode(times)).select(*docs.columns)

    out = repeated(keyed.join(plan.filter(whole), [*NODE]), F.lit(1))
    split = plan.filter(~whole)
    if split.isEmpty():
        return out
    parts = staged(
        keyed.withColumn("__part", F.spark_partition_id()).join(split, [*NODE]), "mix-split"
    )
    inside = F.row_number().over(Window.partitionBy(*NODE, "__part").orderBy(F.lit(0)))
    before = Window.partitionBy(*NODE).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*NODE, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*NODE, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    numbered = parts.withColumn("__inside", inside).join(offsets, [*NODE, "__part"])
    return out.unionByName(repeated(numbered, F.col("__inside") + F.col("__offset")))
