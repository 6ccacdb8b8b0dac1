"""Operator 6: consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Every text hashes to one of ``2^16`` cells of the ring; a cell belongs to the first virtual
node clockwise. A shard takes its cells, heaviest first, until its bound is reached; what
does not fit continues clockwise to the next shard. A cell that holds more than a 4,096th
of all bytes or of all rows (a text with very many copies, the empty one for instance) is
dealt in pieces by a hash of id and size, and a piece that is still as heavy (rows of one id)
by the row's number in a written table; so no key is too large to be balanced or sorted. Loads
come from a map-side sum per cell; the walk round the ring works on that table of bounded size,
in at most as many rounds as there are shards.

Nulls count as empty texts; a null id is an id like any other. Equal rows are separate rows at the
same place. A text of any length is one row and stays whole, so a shard can pass the others by one
text where a single one is larger than the slack. An empty table gives an empty result. Only
the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.store import staged

CELLS = 1 << 16
PIECES = 1 << 10
HEAVY = 1 << 12


def cell_of(text: Column) -> Column:
    """A text's place on the ring."""
    return F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int")


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """One row per cell: the shards met clockwise from there, each once (``route``)."""
    nodes = (
        spark.range(shards * vnodes)
        .select(
            (F.col("id") % shards).cast("int").alias("shard"),
            # a node's place depends on its own shard and number alone
            F.pmod(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(CELLS)).cast("int").alias("at"),
        )
        .groupBy("at")
        .agg(F.min("shard").alias("shard"))
    )
    order = F.expr("transform(nodes, x -> x.shard)")
    whole = nodes.agg(F.sort_array(F.collect_list(F.struct("at", "shard"))).alias("nodes"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    return (
        whole.select(
            "nodes",
            F.posexplode(F.concat("nodes", F.expr(f"array(struct({CELLS - 1} as at, nodes[0].shard as shard))"))).alias("k", "node"),
        )
        .select(
            F.when(F.col("k") == 0, 0).otherwise(F.expr("nodes[k - 1].at + 1")).alias("low"),
            F.col("node.at").alias("high"),
            F.array_distinct(
                F.concat(F.slice(order, F.least(F.col("k") + 1, F.size("nodes")), F.size("nodes")),
                         F.array(F.expr("nodes[0].shard")), order, every)
            ).alias("met"),
            F.col("node.shard").alias("own"),
        )
        .filter("low <= high")
        .select(
            F.explode(F.sequence("low", "high")).alias("cell"),
            F.array_distinct(F.concat(F.array("own"), "met")).alias("route"),
        )
    )


def assign_units(units: DataFrame, bound: int, shards: int, vnodes: int) -> DataFrame:
    """Units ``(cell, piece, cell_load, load, n)`` with the shard that takes each.

    A shard's load stays at or below ``bound``. Units that found no gap on a whole turn, a
    few large ones of a small table, go to the shards with most room, largest first.
    """
    first = Window.partitionBy("shard").orderBy(F.col("cell_load").desc(), "cell", "piece")
    pending = staged(units.join(F.broadcast(ring(units.sparkSession, shards, vnodes)), "cell"), "ring-units")
    taken = None
    for turn in range(shards):
        here, free = pending.withColumn("shard", F.col("route")[turn]), F.lit(bound)
        if taken is not None:
            used = taken.groupBy("shard").agg(F.sum("load").alias("used"))
            here = here.join(F.broadcast(used), "shard", "left")
            free = bound - F.coalesce("used", F.lit(0))
        judged = staged(here.withColumn("fits", F.sum("load").over(first) <= free).drop("used"), "ring-turn")
        placed = judged.filter("fits").drop("fits")
        taken = placed if taken is None else taken.unionByName(placed)
        pending = judged.filter("not fits").drop("shard", "fits")
        if pending.isEmpty():
            return taken
    used = taken.groupBy("shard").agg(F.sum("load").alias("used"))
    every = pending.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = every.join(F.broadcast(used), "shard", "left").select(
        "shard", (F.row_number().over(Window.orderBy(F.coalesce("used", F.lit(0)), "shard")) - 1).alias("nth")
    )
    order = (F.row_number().over(Window.orderBy(F.col("load").desc(), "cell", "piece")) - 1) % shards
    return taken.unionByName(pending.withColumn("nth", order).join(F.broadcast(room), "nth").drop("nth"))


def shard_documents(
    docs: DataFrame, shards: int = 16, vnodes: int = 128, slack: float = 0.0005, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard)`` per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one; shards differ in bytes by about ``slack``
    of their mean. ``slot`` numbers a shard's rows without gaps, copies of a text side by
    side. ``home_shard`` is where the ring puts the text without bounds.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        cell_of(text).alias("cell"),
        F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text)), F.lit(PIECES)).cast("int").alias("part"),
        F.monotonically_increasing_id().alias("row"),
    ), "ring-rows")
    cells = staged(rows.groupBy("cell").agg(F.sum("size").alias("cell_load"), F.count("*").alias("n")), "ring-cells")
    total, many = (x or 0 for x in cells.agg(F.sum("cell_load"), F.sum("n")).first())

    # fewer than 2 * HEAVY cells, or pieces, can hold more than one part in HEAVY of the bytes or of the rows
    def too_much(load: str) -> Column:
        return (F.col(load) * HEAVY > total) | (F.col("n") * HEAVY > many)

    much = too_much("cell_load")
    heavy = cells.filter(much).select("cell", "cell_load", F.lit(True).alias("heavy"))
    dealt = rows.join(F.broadcast(heavy), "cell", "left").withColumn("piece", F.when(F.col("heavy"), F.col("part")).otherwise(-1))
    whole = dealt.filter("heavy").groupBy("cell", "piece").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    still = whole.filter(too_much("load")).select("cell", "piece", F.lit(True).alias("still"))
    by_row = (F.col("piece") + 1) * PIECES + F.pmod(F.xxhash64("row"), F.lit(PIECES)).cast("int")
    dealt = dealt.join(F.broadcast(still), ["cell", "piece"], "left").withColumn("piece", F.when(F.col("still"), by_row).otherwise(F.col("piece")))
    pieces = dealt.filter("heavy").groupBy("cell", "piece", "cell_load").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    light = cells.filter(~much)
    units = pieces.unionByName(light.select("cell", F.lit(-1).alias("piece"), "cell_load", F.col("cell_load").alias("load"), "n"))
    taken = assign_units(units, math.ceil(total * (1 + slack) / shards), shards, vnodes)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = staged(
        taken.select("cell", "piece", "shard", F.coalesce(before, F.lit(0)).alias("base"), F.col("route")[0].alias("home_shard")),
        "ring-placed",
    )
    own = Window.partitionBy("cell", "piece").orderBy("text_crc32", "doc_id", "size", "row")
    return dealt.drop("cell_load").join(placed, ["cell", "piece"]).select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(own) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )
