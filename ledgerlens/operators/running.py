"""Running frames and account joins that don't put a hot key into one task.

A key is hot if it has more rows than a fair share of the shuffle's
partitions; there are at most ``PIECES`` times as many hot keys as partitions,
so tables about them are small by construction and may be broadcast.  Keys
that aren't hot are neither split nor copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A hot key's piece holds about a partition's rows divided by this.
PIECES = 4
#: A piece is not made smaller than this.
LEAST_ROWS = 1000


def hot_keys(rows: DataFrame, keys: list[str], least: int = LEAST_ROWS) -> list:
    """Rows (*keys, n, pieces) of the hot keys: n rows, to be dealt out as so many pieces.

    Two partial aggregates; the driver gets one number, then at most ``PIECES``
    rows a shuffle partition."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), *keys).limit(PIECES * parts + 1).collect()
    if not top or top[0]["n"] <= least:
        return []
    total = counts.agg(F.sum("n")).first()[0]
    share = max(least, -(-total // (PIECES * parts)))
    return [r.asDict() | {"pieces": -(-r["n"] // share)} for r in top if r["n"] > share and all(r[k] is not None for k in keys)]


def _small(rows: DataFrame, hot: list, keys: list[str], extra: str) -> DataFrame:
    """The hot keys as a table to broadcast."""
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[c.split()[0] for c in extra.split(", ")]]
    return F.broadcast(rows.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in hot], f"{types}, {extra}"))


def salted_join(rows: DataFrame, side: DataFrame, on: str, spread: str, keep: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` whose ``on`` is in ``side`` (unique there), with its columns ``keep``.

    A hot key's rows are salted by their column ``spread`` into as many pieces
    as its number of rows asks for, and its row of ``side`` is copied as often."""
    hot = hot_keys(rows, [on], least)
    how = "inner" if keep else "left_semi"
    side = side.select(on, *keep)
    if not hot:
        return rows.join(side, on, how)
    pieces = _small(rows, hot, [on], "pieces long")
    salted = rows.join(pieces, on, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("pieces", F.lit(1)))).drop("pieces")
    copies = side.join(pieces, on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return salted.join(copies, [on, "__salt"], how).drop("__salt")


def left_join(rows: DataFrame, side: DataFrame, on: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``side`` of the same ``on``.

    Rows without a key match nothing, but would all go to one task: they are dealt out by their column ``spread``."""
    none = F.lit(0).cast("long")
    dealt = rows.withColumn("__deal", F.when(F.col(on).isNull(), F.xxhash64(spread)).otherwise(none))
    # always 0, but no constant to the optimizer, which would take it out of the join's keys
    side = side.withColumn("__deal", F.pmod(F.xxhash64(on), F.lit(1).cast("long")))
    return dealt.join(side, [on, "__deal"], "left").drop("__deal")


class Pieces:
    """``rows`` with ``__piece``: 0, or for hot keys the range of ``order`` that a row lies in (equal values in one range)."""

    def __init__(self, rows: DataFrame, keys: list[str], order: str, least: int = LEAST_ROWS, *, even: bool = False):
        """``even``: the caller knows that no key has more than ``least`` rows."""
        self.keys, self.hot = keys, None
        hot = [] if even else hot_keys(rows, keys, least)
        if not hot:
            self.rows = rows.withColumn("__piece", F.lit(0))
            return
        self.hot = _small(rows, hot, keys, "pieces long")
        most = max(r["pieces"] for r in hot)
        marked = rows.join(self.hot, keys).groupBy(*keys, "pieces").agg(
            F.percentile_approx(order, [k / most for k in range(1, most)], 100 * most).alias("cuts"))
        # a key of fewer pieces takes every so many-th cut
        step = F.ceil(F.lit(most) / F.col("pieces"))
        cuts = marked.select(*keys, F.array_distinct(F.filter("cuts", lambda x, i: (i + 1) % step == 0)).alias("cuts")).collect()
        kind = rows.schema[order].dataType.simpleString()
        table = _small(rows, [r.asDict() for r in cuts], keys, f"cuts array<{kind}>")
        place = F.size(F.filter(F.coalesce("cuts", F.array().cast(f"array<{kind}>")), lambda x: x < F.col(order)))
        self.rows = rows.join(table, keys, "left").withColumn("__piece", place).drop("cuts")

    def last(self, df: DataFrame, value: F.Column, order: list[str], out: str, descending: bool = False, strict: bool = False) -> DataFrame:
        """``df`` (rows with ``__piece``) with ``out``: the last value that isn't null, up to each row in the order of the key.

        Inside a piece a running frame; a hot key's later pieces begin with the last value of the earlier ones, one row a piece."""
        sort = [F.desc(c) if descending else F.asc(c) for c in order]
        frame = Window.partitionBy(*self.keys, "__piece").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
        got = df.withColumn(out, F.last(value, ignorenulls=True).over(frame))
        if self.hot is None:
            return got
        at = F.struct(*order)
        some = df.join(self.hot.select(*self.keys), self.keys).withColumn("__value", value).filter("__value IS NOT NULL")
        ends = some.groupBy(*self.keys, "__piece").agg((F.min_by if descending else F.max_by)("__value", at).alias("__end"))
        # every piece of a hot key, so that one without a value passes on what came before it
        every = df.join(self.hot.select(*self.keys), self.keys).select(*self.keys, "__piece").distinct().join(ends, [*self.keys, "__piece"], "left")
        before = Window.partitionBy(*self.keys).orderBy(F.desc("__piece") if descending else F.asc("__piece")).rowsBetween(Window.unboundedPreceding, -1)
        carry = every.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).select(*self.keys, "__piece", "__carry")
        return got.join(F.broadcast(carry), [*self.keys, "__piece"], "left").withColumn(out, F.coalesce(out, "__carry")).drop("__carry")

    def total(self, df: DataFrame, value: F.Column, order: list[str], out: str) -> DataFrame:
        """``df`` (rows with ``__piece``) with ``out``: the sum of the values before each row in the order of the key, 0 at first."""
        frame = Window.partitionBy(*self.keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        got = df.withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)))
        if self.hot is None:
            return got
        sums = df.join(self.hot.select(*self.keys), self.keys).groupBy(*self.keys, "__piece").agg(F.sum(value).alias("__sum"))
        before = Window.partitionBy(*self.keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.withColumn("__carry", F.sum("__sum").over(before)).select(*self.keys, "__piece", "__carry")
        return got.join(F.broadcast(carry), [*self.keys, "__piece"], "left").withColumn(out, F.col(out) + F.coalesce("__carry", F.lit(0))).drop("__carry")
