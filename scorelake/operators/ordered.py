"""Exact order statistics of many keys, without sorting any of them whole."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.sources.shared import delete_table, stored

#: Values of a key, or of a bracket in it, that one task puts in order at most (but for values that are distinct).
GATHERED = 1 << 20
#: Cells of the sketch by which a bracket is narrowed, to about three of them.
CELLS = 256


def usable(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _placed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, _v, _first and _end: of each distinct value of `by` the places that it takes, _end excluded. Values are counted before they meet."""
    counts = rows.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    end = F.sum("_c").over(W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("_end", end).withColumn("_first", F.col("_end") - F.col("_c"))


def _narrowed(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """brackets, each narrowed once: a sketch of the values in it names two of them around the place, and a pass counts the values below, at,
    between and above these. The place is at one of the two, which is the answer, or in one of the three stretches, which is smaller."""
    held = (F.col("lo").isNull() | (F.col("_v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") < F.col("hi")))
    met = lambda b: values.join(b.withColumnRenamed("_key", "_own"), F.col("_key").eqNullSafe(F.col("_own")) & held)
    grid = F.percentile_approx("_v", F.array(*(F.lit(i / CELLS) for i in range(CELLS + 1))), 40 * CELLS)
    cell = F.floor((F.col("rank") - F.col("below")) * CELLS / F.col("inside")).cast("int")
    at = lambda c: F.get("grid", F.greatest(F.lit(0), F.least(c, F.lit(CELLS))))
    state = ["name", "n", "rank", "lo", "hi", "below", "inside"]
    named = met(brackets).groupBy("_key", *state).agg(grid.alias("grid")).select("_key", *state, at(cell - 1).alias("a"), at(cell + 2).alias("b"))
    tried = stored(named, "brackets")  # a row a place
    v, a, b = F.col("_v"), F.col("a"), F.col("b")
    counts = met(tried).groupBy("_key", *state, "a", "b").agg(F.count_if(v < a).alias("c0"), F.count_if(v == a).alias("c1"), F.count_if((v > a) & (v < b)).alias("c2"), F.count_if((v == b) & (b > a)).alias("c3"), F.count_if(v > b).alias("c4"))
    sums = [F.col("below")]
    for i in range(5):
        sums.append(sums[-1] + F.col(f"c{i}"))
    where = F.when(F.col("rank") < sums[1], 0).when(F.col("rank") < sums[2], 1).when(F.col("rank") < sums[3], 2).when(F.col("rank") < sums[4], 3).otherwise(4)
    pick = lambda *of: F.element_at(F.array(*of), F.col("stretch") + 1)
    lo, hi = F.col("lo"), F.col("hi")
    none = F.lit(None).cast(brackets.schema["lo"].dataType)
    new = counts.withColumn("stretch", where).select(
        "_key", "name", "n", "rank", pick(lo, a, a, b, b).alias("lo"), pick(a, a, b, b, hi).alias("hi"), pick(*sums[:5]).alias("below"),
        pick(*(F.col(f"c{i}") for i in range(5))).alias("inside"), pick(none, a, none, b, none).alias("answer"),
    )
    out = stored(new, "brackets")
    delete_table(tried)
    return out


def order_statistics(df: DataFrame, keys: Sequence[str], col: str, places: Mapping[str, Callable[[Column], Column]], gathered: int = GATHERED) -> DataFrame:
    """keys, n and, by the names in places, the values at these places (from 0, cut to whole numbers; given by n) in order, exact. n counts the
    values that are neither null nor NaN; a key of none has no row, and a place outside 0 .. n - 1 is null.

    A key of up to `gathered` values is put in order in one task, as distinct values with counts. For each place of a larger key a bracket is
    narrowed until it is that small: see _narrowed. df is read once for the sizes, twice for each narrowing, of which a thousand million values
    take three, and once in the end, so it must give the same rows again. The driver holds no values.
    """
    c = F.col(f"`{col}`")
    values = df.where(usable(c)).select(F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).alias("_key"), c.alias("_v"))
    sizes = stored(values.groupBy("_key").agg(F.count("*").alias("n")), "sizes")  # a row a key
    own = [(name, F.floor(p(F.col("n"))).cast("long")) for name, p in places.items()]
    large = sizes.where(F.col("n") > gathered)
    if large.isEmpty():
        found = _placed(values, ["_key"]).withColumn("n", F.max("_end").over(W.partitionBy("_key")))
        hit = lambda rank: (rank >= F.col("_first")) & (rank < F.col("_end"))
        out = found.groupBy("_key").agg(F.max("n").alias("n"), *(F.max(F.when(hit(rank), F.col("_v"))).alias(name) for name, rank in own))
    else:
        none = F.lit(None).cast(values.schema["_v"].dataType)
        each = F.inline(F.array(*(F.struct(F.lit(name).alias("name"), rank.alias("rank")) for name, rank in own)))
        state = sizes.select("_key", "n", each).where("rank between 0 and n - 1")
        state = stored(state.select("_key", "name", "n", "rank", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("answer")), "brackets")
        while not (wide := state.where((F.col("inside") > gathered) & F.col("answer").isNull())).isEmpty():
            after = stored(_narrowed(values, wide).unionByName(state.where((F.col("inside") <= gathered) | F.col("answer").isNotNull())), "brackets")
            delete_table(state)
            state = after
        left = state.where("answer is null").select(F.col("_key").alias("_own"), "name", "lo", "hi", "rank", "below")
        inside = F.col("_key").eqNullSafe(F.col("_own")) & (F.col("lo").isNull() | (F.col("_v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") < F.col("hi")))
        met = _placed(values.join(left, inside).withColumn("_rank", F.col("rank") - F.col("below")), ["_key", "name", "_rank"])
        last = met.where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))).select("_key", "name", F.col("_v").alias("answer"))
        picked = last.union(state.where("answer is not null").select("_key", "name", "answer")).groupBy("_key").agg(*(F.max(F.when(F.col("name") == name, F.col("answer"))).alias(name) for name in places))
        p = picked.withColumnRenamed("_key", "_own")
        out = sizes.join(p, F.col("_key").eqNullSafe(F.col("_own")), "left")
    return out.select(*(F.col(f"_key.k{i}").alias(k) for i, k in enumerate(keys)), "n", *places)
