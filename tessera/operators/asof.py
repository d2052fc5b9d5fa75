"""As-of and range joins on sorted keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.timeaxis import ticks


def renamed(left: DataFrame, right: DataFrame, dropped: list[str], suffix: str) -> DataFrame:
    """right without `dropped`, colliding names suffixed; a name that still collides is an error."""
    taken = set(left.columns)
    out = {c: c + suffix if c in taken else c for c in right.columns if c not in dropped}
    clash = [n for n in out.values() if list(out.values()).count(n) > 1 or (n.endswith(suffix) and n in taken)]
    if clash:
        raise ValueError(f"columns {clash} collide even with suffix {suffix!r}")
    return right.withColumnsRenamed(out)


def join_asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: list[str], right_by: list[str], suffix: str = "_2", bucket: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; nulls where there is none.

    One shuffle on the key: both sides are stacked and the last right row is carried forward.  Right rows of equal time go by
    all their remaining columns, the greatest wins.  With `bucket` (ticks), keys are also split by stretches of
    time, so that a key with a large share of the rows is dealt over tasks; the last right row of the
    stretches before is carried over from one row per key and stretch.
    """
    dropped = [*right_by, right_on]
    extra = [c for c in right.columns if c not in dropped]
    wide = renamed(left, right, dropped, suffix)
    names = [c for c in wide.columns if c not in dropped]
    payload = [F.col(f"`{right_on}`").alias("__at"), *[F.col(f"`{c}`").alias(n) for c, n in zip(extra, names, strict=True)]]
    keys = [f"__k{i}" for i in range(len(left_by))]
    rows = left.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(left_by, keys, strict=True)], ticks(left, left_on).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"), F.lit(None).alias("__r"))
    other = right.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(right_by, keys, strict=True)], ticks(right, right_on).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(*payload).alias("__r"))
    other = other.where(F.col("__t").isNotNull())
    stacked = rows.unionByName(other)
    parts = list(keys)
    if bucket:
        stacked = stacked.withColumn("__b", F.floor(F.col("__t") / bucket))
        parts.append("__b")
    along = Window.partitionBy(*parts).orderBy(F.col("__t").asc_nulls_first(), "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = stacked.withColumn("__m", F.last("__r", ignorenulls=True).over(along)).where("__side = 1")
    if bucket:
        lasts = other.withColumn("__b", F.floor(F.col("__t") / bucket)).groupBy(*parts).agg(F.max(F.struct("__t", "__r")).alias("__last"))
        stretches = stacked.select(*parts).distinct().join(lasts, parts, "left")
        before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = stretches.select(*parts, F.last("__last", ignorenulls=True).over(before)["__r"].alias("__c")).where("__c is not null")
        out = out.join(carried, parts, "left").withColumn("__m", F.coalesce("__m", "__c"))
    return out.select("__l.*", *[F.when(F.col("__t").isNotNull(), F.col("__m")[n]).alias(n) for n in names])


#: Rows of a key above which an automatic bucket splits it, so that a stretch holds about as many.
STRETCH_ROWS = 2_000_000


def fitting_bucket(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: list[str], right_by: list[str]) -> int | None:
    """The stretch of time that holds about STRETCH_ROWS rows of the fullest key; None if no key has more.

    Runs one count by key over both sides; only the fullest key reaches the driver.
    """
    sides = [df.select(*[F.col(f"`{b}`").alias(f"k{i}") for i, b in enumerate(by)], ticks(df, on).alias("t")) for df, on, by in ((left, left_on, left_by), (right, right_on, right_by))]
    rows = sides[0].unionByName(sides[1]).where("t is not null")
    counts = rows.groupBy(*[f"k{i}" for i in range(len(left_by))]).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    fullest = counts.orderBy(F.desc("n")).select("n", "span").first()
    if fullest is None or fullest["n"] <= STRETCH_ROWS:
        return None
    return max(1, fullest["span"] * STRETCH_ROWS // fullest["n"])


def join_range(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: list[str], right_by: list[str], before: int, suffix: str = "_2") -> DataFrame:
    """All right rows of the key with left time - before <= right time <= left time; the right time is kept.

    Equi-join on (key, stretch of `before` ticks) with each left row in two stretches, then the exact bounds.
    """
    if before <= 0:
        raise ValueError("before is a positive number of ticks")
    keys = [f"__k{i}" for i in range(len(left_by))]
    r_time = right_on + suffix if right_on in left.columns else right_on
    b = renamed(left, right, right_by, suffix).withColumnsRenamed(dict(zip(right_by, keys, strict=True)))
    a = left.withColumn("__tl", ticks(left, left_on))
    a = a.withColumn("__bin", F.explode(F.array(F.floor(F.col("__tl") / before), F.floor(F.col("__tl") / before) - 1)))
    b = b.withColumn("__tr", ticks(b, r_time)).withColumn("__bin", F.floor(F.col("__tr") / before))
    condition = a["__bin"] == b["__bin"]
    for k, n in zip(left_by, keys, strict=True):
        condition &= a[k] == b[n]
    hit = a.join(b, condition).where((F.col("__tr") <= F.col("__tl")) & (F.col("__tr") >= F.col("__tl") - before))
    return hit.select(*[a[c] for c in left.columns], *[b[c] for c in b.columns if not c.startswith("__")])
