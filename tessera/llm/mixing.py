"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
all words; a target stops at ``cap`` times its source's size and the excess is shared
by weight among the others until none is above.  That is a water level, found from
running sums over the sources sorted by the level that fills them.

Quotas: the total is cut into blocks of equal word count, at least ``MAX_BLOCKS`` where
there are as many words, and so fine that the smallest target is ``LEAST_BLOCKS`` of them.
Blocks go to sources by highest quotients target / (2 j - 1).  Only quotients near
the cut need ranking: a source's quota differs from its proportional share q by less
than 2 + 2 S q / M (S sources, M blocks), so a few rows per source are ranked,
however many blocks there are.  The same step deals a source's blocks to its shards,
sets of documents by seeded hash of some 2^-14 of all words each; a hot source has
proportionally more shards, so no window holds more than a shard.

Selection: a shard's documents in seeded order are a ring of words.  Its quota of
blocks is taken from a seeded start block on, round the ring.  Each document's share
of that run follows from its place by arithmetic, so nothing is exploded.  The seeded
hash is of a document's id and text (and its rank among rows that repeat both), so any
layout of the same rows in files and partitions gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

WEIGHTS = (5, 2, 1)
MAX_BLOCKS = 1 << 20
LEAST_BLOCKS = 64
SHARDS = 1 << 14
#: Tables of up to so many rows that are known to be few are broadcast (some 20 bytes each).
BROADCAST_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    """Number of runs outside [\\x20\\x09-\\x0D]; null: 0."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def apportion(parts: DataFrame, parent: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """``parts`` (one row per part: parent columns, key, votes, its parent's seats) with its Sainte-Lague ``quota``.

    Ties of quotients go to more votes, then to the smaller key.  Parts without
    votes get none.
    """
    group = Window.partitionBy(*parent)
    share = parts.where(F.col(votes) > 0).select(*parent, key, votes, seats)
    share = share.withColumn("q", F.col(votes) * F.col(seats) / F.sum(votes).over(group))
    margin = 2 + F.ceil(2 * F.count("*").over(group) * F.col("q") / F.greatest(F.col(seats), F.lit(1)))
    share = share.withColumn("margin", margin.cast("long"))
    share = share.withColumn("sure", F.greatest(F.lit(0), F.floor("q") - F.col("margin")).cast("long"))
    share = share.withColumn("open", F.col(seats) - F.sum("sure").over(group))
    ranked = share.withColumn("j", F.explode(F.expr("sequence(sure + 1, cast(floor(q) as long) + margin + 1)")))
    order = group.orderBy((F.col(votes) / (2 * F.col("j") - 1)).desc(), F.col(votes).desc(), F.col(key), F.col("j"))
    won = ranked.withColumn("rank", F.row_number().over(order)).where("rank <= open")
    won = won.groupBy(*parent, key).agg(F.count("*").alias("won"))
    quota = share.select(*parent, key, "sure").join(won, [*parent, key], "left")
    quota = quota.select(*parent, key, (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))
    return parts.join(quota, [*parent, key], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def targets(sources: DataFrame, cap: int) -> DataFrame:
    """``sources`` (source, source_size) with weight, target, total."""
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").isNull(), "source")
    x = sources.withColumn("place", F.row_number().over(by_name)).withColumn("total", F.sum("source_size").over(one))
    x = x.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
    x = x.withColumn("most", F.col("source_size") * cap).withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = one.orderBy("full_at", "place")
    filled = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (F.col("total") - filled) / rest)
    fits = F.col("full_at") >= F.col("level") * (1 - 1e-12)
    x = x.withColumn("at", F.min(F.when(fits, F.struct("full_at", "place", "level"))).over(one))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce(F.col("at.level"), F.lit(0.0)))
    return x.select("source", "source_size", "place", "weight", "total", target.alias("target"))


def mix_plan(rows: DataFrame, seed: int = 17, cap: int = 3) -> DataFrame:
    """``rows`` (row, doc_id, t, rank, source, size) with source_size, weight, target, taken.

    ``taken`` counts words, repeats included, and is at most ``cap`` times ``size``.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, cap)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(0)))
    finest = F.floor(F.least(F.ceil(F.col("total") / MAX_BLOCKS), F.coalesce(smallest, F.lit(0.0)) / LEAST_BLOCKS))
    goal = goal.withColumn("block", F.greatest(F.lit(1), finest).cast("long"))
    goal = goal.withColumn("blocks", F.round(F.col("total") / F.col("block")).cast("long")).withColumn("all", F.lit(0))
    goal = apportion(goal, ["all"], "place", "target", "blocks")
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(64), F.ceil(F.col("total") / SHARDS)))).cast("long"))
    goal = save(goal.select("source", "place", "source_size", "weight", "target", "block", F.col("quota").alias("source_quota"), "shards"), "mix-sources")
    lot = F.xxhash64("doc_id", "t", "rank", F.lit(seed))
    placed = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    placed = placed.withColumn("lot", lot).withColumn("shard", F.pmod("lot", "shards"))
    placed = save(placed, "mix-rows")
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("length"), F.max("source_quota").alias("source_quota"), F.max("block").alias("block"))
    shards = apportion(shards, ["place"], "shard", "length", "source_quota")
    words = F.least(F.col("quota") * F.col("block"), F.col("length") * cap)
    shards = shards.select(
        "place",
        "shard",
        "length",
        F.when(F.col("length") > 0, F.floor(words / F.col("length"))).otherwise(0).cast("long").alias("laps"),
        F.when(F.col("length") > 0, words % F.col("length")).otherwise(0).alias("rest"),
        (F.pmod(F.xxhash64("place", "shard", F.lit(seed + 1)), F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("block")))) * F.col("block")).alias("from"),
    )
    shards = save(shards, "mix-shards")
    ring = Window.partitionBy("place", "shard").orderBy("lot", "doc_id", "t", "rank")
    placed = placed.withColumn("end", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(shards, ["place", "shard"])
    begin, end = F.col("end") - F.col("size"), F.col("end")

    def shared(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, b) - F.greatest(begin, a))

    first = shared(F.col("from"), F.least(F.col("from") + F.col("rest"), F.col("length")))
    wrapped = shared(F.lit(0), F.col("from") + F.col("rest") - F.col("length"))
    taken = (F.col("laps") * F.col("size") + first + wrapped).cast("long")
    # as whole copies: a further one where the run ends behind the document's middle word
    middle = begin + F.floor(F.col("size") / 2)
    offset = F.pmod(middle - F.col("from"), F.greatest(F.col("length"), F.lit(1)))
    copies = F.col("laps") + F.when((F.col("size") > 0) & (offset < F.col("rest")), 1).otherwise(0)
    return placed.select("row", "doc_id", "source", "size", "source_size", "weight", "target", taken.alias("taken"), copies.cast("int").alias("copies"))


def _sizes(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, t (hash of the text), size, rank of ``docs`` (row, doc_id, source, text), saved.

    ``rank`` numbers rows that repeat id, text and source, 0 for most: ranks are given within
    salted parts of such rows, after the counts of the parts before.
    """
    key = ["doc_id", "t", "source"]
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("t"), word_count(F.col("text")).alias("size"))
    rows = save(rows, "mix-sizes")
    again = save(rows.groupBy(*key).count().where("count > 1").drop("count"), "mix-repeated")
    if again.isEmpty():
        return rows.withColumn("rank", F.lit(0).cast("long"))
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    same = lambda other: [rows[c].eqNullSafe(other[c]) for c in key]
    once = rows.join(few, same(few), "left_anti").withColumn("rank", F.lit(0).cast("long"))
    many = rows.join(few, same(few), "left_semi").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
    parts = many.groupBy(*key, "salt").count()
    before = F.sum("count").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(f"p_{c}") for c in (*key, "salt")), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = many.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "salt").orderBy("row")))
    ranked = ranked.join(parts, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*key, "salt")])
    return save(once.unionByName(ranked.select(*once.columns[:-1], (F.col("before") + F.col("nth") - 1).cast("long").alias("rank"))), "mix-ranks")


def mix_sources(docs: DataFrame, seed: int = 17, cap: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source, weight.

    Null or blank text has size 0 and is never taken.  A null source is a source of its
    own, the last.  Repeated rows are rows of their own.  An empty table, or one
    without words, has targets and takes of 0.  Other columns are not read.
    """
    rows = _sizes(docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id()))
    return mix_plan(rows, seed, cap).select("doc_id", "size", "source_size", "target", "taken", "source", "weight")


def mixed_documents(docs: DataFrame, seed: int = 17, cap: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs`` in whole copies, columns unchanged.

    A document is repeated as often as the selected run passes its middle word; one it
    never passes goes.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    kept = save(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    rows = _sizes(kept.select("row", *(F.col(at[c]).alias(c) for c in ("doc_id", "source", "text"))))
    plan = mix_plan(rows, seed, cap).where("copies > 0").select("row", "copies")
    out = kept.join(plan, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*names).toDF(*docs.columns)


__all__ = ["apportion", "mix_plan", "mix_sources", "mixed_documents", "targets", "word_count"]
