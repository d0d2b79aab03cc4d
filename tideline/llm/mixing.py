"""Mixing sources to target weights by a splitting tree (DataFrame operations only).

Documents of a source are hashed into permuted blocks. A source's target says how many whole passes
over its blocks the mix takes, and how far into one more pass it goes. These exact block quotas are
split between output shards by a binary tree: every node draws one half of its blocks without
replacement (a multivariate hypergeometric draw, done by ranking the node's blocks by hash), so that
each shard gets its fair share of each source. A source's permuted blocks are then dealt to the
shards in order, so shards are disjoint, and each shard is shuffled locally by hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, words

#: Blocks of a source. Their number does not grow with the documents; their size does.
BLOCKS = 256
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
LEVELS = 4


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, skey, source_size) with ``target``: weighted shares of the sum of all sizes.

    No target exceeds ``most`` times its source; what is over goes to the others by weight. The shares
    that come out are ``min(most * size, level * weight)``: sources are sorted by the level at which
    they are full; the first level that fills none of the later ones is the right one, and the greatest such.
    One row per source, so these windows over all of them stay small.
    """
    names = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("_full", "skey").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("_full", "skey").rowsBetween(0, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("_k", (F.row_number().over(names) - 1) % len(weights))
        .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k") + 1))
        .withColumn("_cap", (F.col("source_size") * most).cast("double"))
        .withColumn("_full", F.col("_cap") / F.col("_w"))
    )
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    levels = ranked.withColumn(
        "_level", (total - F.coalesce(F.sum("_cap").over(by_level), F.lit(0.0))) / F.sum("_w").over(rest)
    )
    level = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(W.partitionBy())
    return levels.select(
        "source",
        "skey",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.withColumns(
        {
            "size": F.size(words(F.col(text))).cast("long"),
            "skey": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
            "block": F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"),
            "pos": F.conv(F.substring(digest, 3, 15), 16, 10).cast("long"),
        }
    )


def _quotas(rows: DataFrame, weights: Sequence[float], most: int) -> tuple[DataFrame, DataFrame]:
    """Per source: what the mix takes. Per source and block: its place in the permuted order."""
    up_to = W.partitionBy("skey").orderBy("rank")
    blocks = (
        rows.groupBy("source", "skey", "block")
        .agg(F.sum("size").alias("bsize"))
        .withColumn(
            "rank",
            F.row_number().over(
                W.partitionBy("skey").orderBy(F.md5(F.concat_ws(":", F.lit("block"), "skey", F.col("block").cast("string"))), "block")
            )
            - 1,
        )
        .withColumn("cum", F.sum("bsize").over(up_to))
    )
    blocks = staged(blocks, "blocks")
    sizes = blocks.groupBy("source", "skey").agg(F.sum("bsize").alias("source_size"), F.count("*").alias("n_blocks"))
    goal = targets(sizes.drop("n_blocks"), weights, most).join(sizes.select("skey", "n_blocks"), "skey")
    goal = goal.withColumn("_goal", F.round("target").cast("long")).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.expr("_goal div source_size")).otherwise(F.lit(0).cast("long"))
    )
    goal = goal.withColumn("rest", F.expr("_goal - passes * source_size")).drop("_goal")
    # whole blocks of the last pass, then documents of the block at its end
    whole = (
        blocks.join(goal.select("skey", "rest"), "skey")
        .where("cum <= rest and rest > 0")
        .groupBy("skey")
        .agg(F.max("rank").alias("last"), F.max("cum").alias("got"))
    )
    goal = goal.join(whole, "skey", "left").withColumns(
        {"whole": F.coalesce(F.col("last") + 1, F.lit(0)), "left": F.col("rest") - F.coalesce("got", F.lit(0))}
    )
    goal = staged(goal.drop("last", "got", "rest"), "goal")
    ends = goal.join(blocks.select("skey", "block", "rank"), "skey").where("rank = whole and left > 0")
    places = (
        rows.join(ends.select("skey", "block", "left"), ["skey", "block"])
        .groupBy("skey", "pos", "left")
        .agg(F.sum("size").alias("psize"))
        .withColumn("cum", F.sum("psize").over(W.partitionBy("skey").orderBy("pos")))
        .where("cum <= left")
        .groupBy("skey")
        .agg(F.max("pos").alias("cut"), F.max("cum").alias("got"))
    )
    goal = goal.join(places, "skey", "left").withColumn("gap", F.col("left") - F.coalesce("got", F.lit(0))).drop("got")
    goal = staged(goal, "cuts")
    # of the documents left out, the one that brings the source nearest to its target completes it
    out = (
        rows.join(blocks.select("skey", "block", "rank"), ["skey", "block"])
        .join(goal.where("gap > 0").select("skey", "whole", "cut", "gap"), "skey")
        .where("rank > whole or (rank = whole and (cut is null or pos > cut))")
        .groupBy("skey", "block", "pos", "gap")
        .agg(F.sum("size").alias("psize"))
        .where("abs(psize - gap) < gap")
        .groupBy("skey")
        .agg(F.min(F.struct(F.expr("abs(psize - gap)"), F.col("block"), F.col("pos"))).alias("_b"))
        .select("skey", F.col("_b.block").alias("add_block"), F.col("_b.pos").alias("add_pos"))
    )
    return staged(goal.join(out, "skey", "left"), "quotas"), blocks


def split_tree(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Shard of each unit (skey, unit) where ``quotas`` has (skey, units) block units of each source.

    There are at most copies x BLOCKS units a source, whatever the number of documents.
    """
    units = quotas.where("units > 0").select("skey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("unit"))

    def halve(df: DataFrame, level: int) -> DataFrame:
        node = W.partitionBy("node")
        key = F.md5(F.concat_ws(":", F.lit(f"tree{level}"), F.col("node").cast("string"), "skey", F.col("unit").cast("string")))
        right = F.row_number().over(node.orderBy(key, "skey", "unit")) > F.ceil(F.count("*").over(node) / 2)
        return df.withColumn("_right", right.cast("int")).withColumn("node", F.col("node") * 2 + F.col("_right")).drop("_right")

    drawn = reduce(halve, range(levels), units.withColumn("node", F.lit(0)))
    counts = drawn.groupBy("skey", "node").agg(F.count("*").alias("n"))
    upto = W.partitionBy("skey").orderBy("node")
    return counts.withColumn("to", F.sum("n").over(upto)).select(
        "skey",
        F.col("node").alias("shard"),
        F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("unit"),
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_COPIES,
    levels: int = LEVELS,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``copies``, ``taken`` and ``shards``.

    ``shards`` has the shard (0 to 2**levels - 1) of each copy. Sources by code point, null last, weigh
    ``weights`` in turn. Whole documents are taken; after the last block one document more, if that
    brings the source nearer to its target. Decisions depend on ids, sizes and sources alone, so reruns
    agree.

    Defined results: a null or empty text has size 0 and is taken with its block; a null source is a
    source of its own; a source without words has target 0; rows with equal ids share block and place
    and are taken together; an empty table gives no rows. Other columns are passed through; a column of
    this list whose name is taken gets the prefix ``mix_``.
    """
    made = ["size", "source_size", "target", "copies", "taken", "shards"]
    # the row travels as one column, so that no name in it can clash
    whole = F.struct(*docs.columns).alias("_row")
    rows = _keyed(docs.select(whole, "doc_id", "source", F.col(text).alias("_text")), "_text").drop("doc_id", "_text")
    quotas, blocks = _quotas(staged(rows.select("source", "skey", "size", "block", "pos"), "sizes"), weights, most)
    quotas = quotas.withColumn(
        "units", F.expr("passes * n_blocks + whole + if(cut is null and add_pos is null, 0, 1)")
    )
    tree = split_tree(quotas, levels)
    dealt = (
        tree.join(quotas.select("skey", "n_blocks", "passes", "units", "whole"), "skey")
        .withColumns({"pass": F.expr("unit div n_blocks"), "rank": F.expr("cast(unit % n_blocks as int)")})
        .groupBy("skey", "rank")
        .agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("_dealt"))
    )
    last = tree.join(quotas.select("skey", "units"), "skey").where("unit = units - 1").select("skey", F.col("shard").alias("last_shard"))
    plan = (
        blocks.select("skey", "block", "rank")
        .join(dealt, ["skey", "rank"], "left")
        .join(quotas.drop("source", "units", "n_blocks"), "skey")
        .join(last, "skey", "left")
    )
    plan = staged(plan, "plan")
    part = F.expr("rank < whole or (rank = whole and cut is not null and pos <= cut)").cast("int")
    added = F.coalesce(F.expr("block = add_block and pos = add_pos"), F.lit(False)).cast("int")
    own = F.slice(F.transform(F.coalesce("_dealt", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda x: x["shard"]), 1, F.col("passes").cast("int") + F.col("_part"))
    return (
        rows.join(plan, ["skey", "block"])
        .withColumns({"_part": part, "_added": added})
        .withColumns(
            {
                "copies": F.col("passes") + F.col("_part") + F.col("_added"),
                "shards": F.concat(own, F.when(F.col("_added") == 1, F.array("last_shard")).otherwise(F.array().cast("array<int>"))),
            }
        )
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("_row.*", *[F.col(c).alias(_free(c, docs.columns)) for c in made])
    )


def _free(name: str, taken: Sequence[str]) -> str:
    return name if name.lower() not in [t.lower() for t in taken] else _free(f"mix_{name}", taken)


def drawn(docs: DataFrame, ordered: bool = False, **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy, with ``copy``, ``shard`` and its place key ``shuffle`` in the shard.

    ``ordered`` writes it down as it is to be read: shard by shard, shuffled inside each. Names that are taken
    get the prefix ``mix_``; ``how`` goes to :func:`mix`.
    """
    copy, shard, shuffle = (_free(c, docs.columns) for c in ("copy", "shard", "shuffle"))
    rows = mix(docs, **how)
    shards = rows.columns[-1]
    rows = rows.select(*docs.columns, F.posexplode(shards).alias(copy, shard))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn(shuffle, F.md5(F.concat_ws(":", F.lit("mix"), F.col(shard).cast("string"), name, F.col(copy).cast("string"))))
    return rows.repartitionByRange(shard, shuffle).sortWithinPartitions(shard, shuffle) if ordered else rows
