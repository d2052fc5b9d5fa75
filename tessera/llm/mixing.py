"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

1. Each source gets a target: its weight's share of the budget, at most `max_repeat` times its own size, what is
   cut off being shared again by weight.  That is min(cap, level * weight) with one level for all,
   found by one pass over the sources in the order in which they fill up.
2. Targets become equal blocks of `block` tokens by highest quotients target / (2 k + 1): those of half a block and more compete for
   a house of as many blocks as all targets make.
3. A source's seats are dealt to its shards (documents by hash of their id) the same way:
   the highest quotients tokens / (2 k + 1) win, none beyond what the shard can give.
   What blocks leave of the target is made up for, so a source of less than half a block still gets its tokens.
4. A shard lays its documents out in an order drawn from the seed, `max_repeat` times over, and gives its first blocks.

Which quotients win is found exactly: with n parties of T votes and h seats, the divisor lies between T / (h + n / 2) and T / (h - n / 2),
so all but 2 n quotients are settled beforehand.  Those left are ranked, and tokens are summed along shards, by sorted ranges whose
sums are added up afterwards, so that no task holds all shards of a source.

Texts are read once, for their sizes; everything after works on (id, source, size) in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage


def word_count(text: str) -> Column:
    """Stretches without white space (space and controls 9 to 13); 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], max_repeat: float) -> DataFrame:
    """sizes: (source, source_size), a row a source.  Adds weight and target; nothing to share gives targets of 0."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(pattern, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    every = fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.least(F.sum("source_size").over(every) * F.lit(share), F.sum("cap").over(every))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    tried = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first_open = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(every)
    return tried.withColumn("target", F.coalesce(F.least(F.col("cap"), first_open * F.col("weight")), F.col("cap"))).select("source", "source_size", "weight", "target")


def before(df: DataFrame, group: str, order: list, value: Column) -> DataFrame:
    """df in the shared folder, with `before`: the sum of value over the rows of the group that come earlier.

    Rows lie in sorted ranges; a window takes one range of a group, and the sums of ranges are as few as the partitions.
    """
    ranged = stage(df.withColumn("value", value).repartitionByRange(group, *order).withColumn("pid", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("pid", group).agg(F.sum("value").alias("total"))
    earlier = F.sum("total").over(Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("pid", group, F.coalesce(earlier, F.lit(0)).alias("offset"))
    within = F.sum("value").over(Window.partitionBy("pid", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("value")
    return ranged.withColumn("within", within).join(sums, ["pid", group]).withColumn("before", F.col("within") + F.col("offset")).drop("pid", "value", "within", "offset")


def apportioned(parties: DataFrame, houses: DataFrame) -> DataFrame:
    """(group, party, seats) of parties (group, party, votes, most) by highest quotients votes / (2 k + 1), k below most.

    houses: (group, house), the seats of each group; all are given if the parties may take as many.  Equal quotients go by party, then k.
    """
    totals = parties.groupBy("group").agg(F.sum("votes").alias("total"), F.count("*").alias("n")).join(houses, "group")
    spare = F.col("n") / 2.0
    share = F.when(F.col("total") > 0, F.col("votes") / F.col("total")).otherwise(0.0)
    # Seats at the greatest and at the least divisor that may be the right one.
    least = F.greatest(F.ceil(share * (F.col("house") - spare) - 0.5), F.lit(0))
    most = F.floor(share * (F.col("house") + spare) + 0.5)
    rows = parties.join(totals, "group").withColumn("sure", F.least(least, F.col("most"))).withColumn("upper", F.least(most, F.col("most")))
    rows = stage(rows.select("group", "party", "votes", "most", "house", "sure", "upper"), "parties")
    sums = rows.groupBy("group").agg((F.max("house") - F.sum("sure")).alias("free"), (F.sum("upper") < F.max("house")).alias("short"))
    rows = rows.join(sums, "group")
    ends = F.when(F.col("short"), F.col("most")).otherwise(F.col("upper"))
    ks = F.when(ends > F.col("sure"), F.sequence(F.col("sure"), F.greatest(ends - 1, F.col("sure"))))
    open_ = rows.select("group", "party", "votes", "free", F.explode(ks).alias("k")).withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1))
    won = before(open_, "group", [F.desc("quotient"), F.col("party"), F.col("k")], F.lit(1)).where("before < free")
    won = won.groupBy("group", "party").agg(F.count("*").alias("won"))
    return rows.join(won, ["group", "party"], "left").select("group", "party", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 2, block: int = 256, seed: int = 20, docs_per_shard: int = 20_000) -> DataFrame:
    """key, source, size, source_size, target, taken; one row for each input row.

    A null source is one of its own, last in order; a null text has size 0.  Repeated rows are taken one by one; a shard that many
    rows of one key make larger than four shards is dealt out by place in the table.  Texts of any length are measured whole.
    Other columns, whatever their names, are not looked at; ties go by key and size; an empty table gives no rows.
    The same rows and seed give the same result, up to which of wholly equal rows is which.
    """
    named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(f"`{text}`").alias("size"))
    rows = stage(rows.withColumn("group", named).withColumn("at", F.monotonically_increasing_id()), "sizes")
    shards = max(64, rows.count() // docs_per_shard)
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("key").cast("string"), "size")).withColumn("place", F.pmod(F.xxhash64("draw"), F.lit(shards)))
    crowded = rows.groupBy("group", "place").agg(F.count("*").alias("rows")).where(F.col("rows") > 4 * docs_per_shard)
    crowded = stage(crowded.withColumn("pieces", F.ceil(F.col("rows") / docs_per_shard)).drop("rows"), "crowded")
    piece = F.coalesce(F.pmod(F.xxhash64("at"), F.col("pieces")), F.lit(0))
    rows = rows.join(F.broadcast(crowded) if crowded.count() < 100_000 else crowded, ["group", "place"], "left")
    rows = rows.withColumn("party", F.col("place") + piece * shards).drop("place", "pieces", "at")
    per_shard = stage(rows.groupBy("group", "party").agg(F.sum("size").alias("tokens"), F.first("source").alias("source")), "shards")
    sizes = per_shard.groupBy("group").agg(F.sum("tokens").alias("source_size"), F.first("source").alias("source"))
    wanted = stage(targets(sizes.select("source", "source_size"), share, weights, max_repeat).withColumn("group", named), "targets")
    blocks = F.floor(F.col("target") / block + 0.5)
    house = wanted.agg(F.least(F.floor(F.sum("target") / block + 0.5), F.sum(blocks)).alias("house")).select(F.lit(0).alias("group"), "house")
    seats = apportioned(wanted.select(F.lit(0).alias("group"), F.col("group").alias("party"), F.col("target").alias("votes"), blocks.alias("most")), house)
    seats = stage(seats.select(F.col("party").alias("group"), F.col("seats").alias("house")), "seats")
    most = F.ceil(F.col("tokens") * F.lit(max_repeat) / block)
    won = apportioned(per_shard.select("group", "party", F.col("tokens").cast("double").alias("votes"), most.alias("most")), seats)
    quota = F.least(F.col("seats") * block, F.col("tokens") * F.lit(max_repeat))
    quotas = stage(per_shard.select("group", "party", "tokens").join(won, ["group", "party"]).select("group", "party", "tokens", quota.alias("quota")), "quotas")
    # What short last blocks, and targets above whole blocks, lack goes to the source's shards one after another: what room
    # their first copies have, then their second.  So documents are taken whole, but for one at the end.
    given = quotas.groupBy("group").agg(F.sum("quota").alias("sum")).join(wanted, "group")
    given = stage(given.select("group", "source_size", "target", F.greatest(F.floor("target") - F.col("sum"), F.lit(0)).alias("lacking")), "lacking")
    laps = F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))
    rooms = quotas.withColumn("lap", laps)
    rooms = rooms.withColumn("room", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("tokens") * (F.col("lap") + 1) - F.col("quota"))))
    rooms = before(rooms, "group", [F.col("lap"), F.col("party")], F.col("room")).join(given, "group")
    extra = F.greatest(F.lit(0), F.least(F.col("room"), F.col("lacking") - F.col("before")))
    quotas = rooms.groupBy("group", "party", "tokens", "source_size", "target").agg((F.max("quota") + F.sum(extra)).alias("quota"))
    laid = rows.join(quotas, ["group", "party"])
    along = Window.partitionBy("group", "party").orderBy("draw", "key", "size")
    laid = laid.withColumn("end", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.lit(0)
    for lap in range(max_repeat):  # the part of the lap's stretch [end - size, end) that lies before the quota
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("tokens") * lap - F.col("end") + F.col("size")))
    return laid.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df's columns, each row as often as the mix takes most of a copy of it: round(taken / size) times.

    A row of size 0 carries no tokens and is kept once.  Rows whose key repeats, or is null, are taken as the mean of their shares.
    All else is as for `mix`.
    """
    share = mix(df, key, text, **options).groupBy(F.col(key).alias("m_key")).agg(F.sum("size").alias("m_size"), F.sum("taken").alias("m_taken"))
    times = F.when(F.col("m_size") == 0, 1).otherwise(F.round(F.col("m_taken") / F.col("m_size"))).cast("int")
    joined = df.join(share, F.col(f"`{key}`").eqNullSafe(F.col("m_key")))
    names = [F.col(f"`{c}`") for c in df.columns]
    laps = joined.withColumn("__times", times).where("__times > 0")
    return laps.select(*names, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__lap")).select(*names)
