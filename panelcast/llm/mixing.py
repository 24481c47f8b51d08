"""Mixing sources to target weights by systematic sampling.

A source's target divided by its size is the number of copies expected of each of its
documents.  The documents of a source stand in a fixed order (size class, then a hash of id
and seed, then the id, the size and a hash of the text); the running sum of expected copies plus one random offset per source
gives a copy each time it passes an integer.  A document therefore gets the whole part of its
expectation or one more, and because neighbours are alike in size, the words taken stay
within about one size class step of the target.  Copies are counted in whole 2^-24ths, so
sums of any length are exact and reruns agree.

The running sum is not one window per source: the order is cut into cells (source, size
class, first hash digits), cells are summed by a partial aggregation, and only the small table of
cells is prefix-summed.  The digits are as many as keep a cell under ``cell_rows`` rows; the
order, and so the result, does not depend on them.

Targets: the total (150 % of all sizes) is shared by weight; a target stops at ``most`` times
its source's size, and the excess is shared again among the others until none is above.  One
row per source goes to the driver; more than ``max_sources`` sources is an error.

Defined cases: a null or empty text has size 0 and takes nothing (it may still be emitted); a
null source is a source of its own, last in order; a source of size 0 has target 0; repeated rows
are documents of their own; rows with null ids stand by a hash of their text; an empty table gives an empty
result; other columns are carried along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import prepare

WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
UNIT = 1 << 24


def n_words(text: Column) -> Column:
    """Words of a text; null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Digits and the two leading digits: classes a tenth wide at most."""
    s = size.cast("string")
    return (F.length(s) * 100 + F.substring(s, 1, 2).cast("int")).cast("int")


def shuffle_hash(key: Column, seed: int, text: Column | None = None) -> Column:
    """Where a row stands among its like; rows without a key are told apart by their text."""
    other = F.lit("") if text is None else F.concat(F.lit("?"), F.xxhash64(text).cast("string"))
    return F.md5(F.concat(F.coalesce(key.cast("string"), other), F.lit(f":{seed}")))


def offset_units(source: Column, seed: int) -> Column:
    """The one random offset of a source, in units of a copy."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("")), F.when(source.isNull(), F.lit("?")).otherwise(F.lit("=")), F.lit(f"{seed}"))), 1, 6), 16, 10).cast("long")


def share_targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Targets by source: shared by weight, stopped at ``most`` times the size, excess shared again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not above:
            target.update({s: left * weight[s] / whole for s in open_})
            break
        target.update({s: most * sizes[s] for s in above})
        left -= sum(most * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in set(above)]
    return {s: float(max(0.0, target[s])) for s in order}


def plan_copies(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] | None = None,
    cell_rows: int = 1_000_000,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``__size, __source_size, __target, __copies``."""
    spark = prepare(docs.sparkSession)
    cols = docs.columns if keep is None else list(keep)
    rows = docs.select(*[F.col(c) for c in cols], n_words(F.col(text_col)).alias("__size"), F.col(source_col).alias("__source"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.withColumn("__tie", F.xxhash64("__text")).withColumn("__class", size_class(F.col("__size"))).withColumn("__hash", shuffle_hash(F.col("__id"), seed, F.col("__text")))
    rows = rows.drop("__text")
    slim = rows.select("__source", "__class", "__hash", "__size")

    per_class = slim.groupBy("__source", "__class").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n"))
    per_source = per_class.groupBy("__source").agg(F.sum("size").alias("size"), F.max("n").alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["__source"]: int(r["size"]) for r in per_source}
    targets = share_targets(sizes, weights, share, most)
    largest = max([r["n"] for r in per_source], default=0)
    digits = max(0, math.ceil(math.log(max(1, largest / cell_rows), 16)))

    rate = [(s, sizes[s], targets[s], math.floor(targets[s] / sizes[s] * UNIT) if sizes[s] else 0) for s in sizes]
    rates = spark.createDataFrame(rate, "__source string, __source_size long, __target double, __rate long")
    cell = ["__source", "__class", "__cut"]
    cut = F.substring("__hash", 1, digits) if digits else F.lit("")
    same = lambda a, b: a["__source"].eqNullSafe(b["__source"])

    cells = slim.withColumn("__cut", cut).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__source").orderBy("__class", "__cut").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cells.join(rates, same(cells, rates)).select(cells["__source"].alias("__cs"), cells["__class"].alias("__cc"), cells["__cut"].alias("__ck"), "__before", "__source_size", "__target", "__rate")

    within = Window.partitionBy(*cell).orderBy("__hash", F.col("__id").asc_nulls_last(), "__size", "__tie")
    placed = rows.withColumn("__cut", cut).withColumn("__place", F.row_number().over(within))
    on = placed["__source"].eqNullSafe(cells["__cs"]) & (placed["__class"] == cells["__cc"]) & (placed["__cut"] == cells["__ck"])
    full = placed.join(cells, on)
    upto = (F.col("__before") + F.col("__place")) * F.col("__rate") + offset_units(F.col("__source"), seed)
    return full.withColumn("__copies", (F.shiftright(upto, 24) - F.shiftright(upto - F.col("__rate"), 24)).cast("int")).select(*cols, "__size", "__source_size", "__target", "__copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it has copies, with the columns of ``docs``."""
    cols = docs.columns
    copies = F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies")))
    return plan_copies(docs, **options).withColumn("__copy", F.explode(copies)).select(*cols)
