"""Operator 9: mixing sources to target weights by fixed-length blocks.

The words of a source form one stream, documents by id; it is packed into blocks of ``block``
words. Targets follow from weights, with a ceiling of ``passes`` times a source. Output shards
have a fixed number of slots. Every shard draws multinomial source counts with a generator
of its own seed; draws beyond a source's exact number of slots go over to sources that fell
short, so totals are exact. A source's j-th slot takes block ``p(j mod blocks)`` of pass
``j div blocks``, where p is a pseudorandom permutation of the pass (a Feistel network,
computed for each index alone). Blocks and slots meet by ``(source, block)``.

A block is drawn once per pass at most, so nothing is taken more than ``passes`` times.
What the driver holds is one row per source. Streams are numbered by range partitions with
one sum per partition and source, so a source with most of all rows is spread over tasks.

Nulls: a null text has no words, a null source is a source of its own and comes last, a null
id comes first. Texts of any length are packed whole. Rows equal in id and text stand next to each other in their stream, which of
them comes first does not matter. An empty table, or one without words, gives every row
``taken`` 0. Only id, text and source are read, besides columns named in ``carry``.
"""

from __future__ import annotations

from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlsieve.llm.store import parts, staged, table
from urlsieve.llm.text import spans, utf8

WEIGHTS = (3, 1, 2)
SLOTS = 1 << 16
NO_ID = -(2**63)


def targets(sizes: dict[str, int], share: float, passes: int, weights: tuple[int, ...] = WEIGHTS) -> dict[str, float]:
    """Words to take of each source: ``share`` of all, by weight, none above ``passes`` times its size."""
    weight = dict(zip(sorted(sizes), cycle(weights), strict=False))
    out: dict[str, float] = {}
    rest, open_ = share * sum(sizes.values()), set(sizes)
    while open_:
        each = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if each * weight[s] > passes * sizes[s]}
        if not above:
            return out | {s: each * weight[s] for s in open_}
        out |= {s: float(passes * sizes[s]) for s in above}
        rest -= sum(out[s] for s in above)
        open_ -= above
    return out


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of ``range(size)``."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, size]).integers(0, 2**63, 4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            f = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(40)) & mask
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= size)):  # walk on until inside; fewer than 4 steps on average
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row; a null is told from an empty text."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool = False) -> DataFrame:
    """``(doc_id, t, r, skey, size, offset)`` per row: where its words begin in its source's stream.

    ``t`` is a hash of the text, ``r`` with ``whole`` one of all columns, else 0.
    """

    def count(source):
        for batch in parts(source, "text"):
            _, _, first = spans(*utf8(batch.column("text")))
            yield table(["doc_id", "t", "r", "skey", "size"], [*(batch.column(c) for c in ("doc_id", "t", "r", "skey")), pa.array(np.diff(first), pa.int64())])

    def number(source):
        part, at = TaskContext.get().partitionId(), {}
        for batch in source:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            keys = batch.column("skey").to_numpy(zero_copy_only=False)
            offsets = np.cumsum(sizes) - sizes
            cuts = [*np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                had = at.get(keys[a], 0)
                offsets[a:b] += had - offsets[a]
                at = {keys[a]: had + int(sizes[a:b].sum())}  # sources come one after the other
            yield table(["doc_id", "t", "r", "skey", "size", "at", "part"], [*batch.columns, pa.array(offsets, pa.int64()), pa.array([part] * len(keys), pa.int32())])

    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
        (row_hash(docs) if whole else F.lit(0).cast("long")).alias("r"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("skey"),
        F.col(text_col).alias("text"),
    )
    sized = staged(rows.mapInArrow(count, "doc_id long, t long, r long, skey string, size long"), "mix-sized")
    ranged = sized.repartitionByRange("skey", "doc_id", "t", "r").sortWithinPartitions("skey", "doc_id", "t", "r")
    numbered = staged(ranged.mapInArrow(number, "doc_id long, t long, r long, skey string, size long, at long, part int"), "mix-numbered")
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = numbered.groupBy("skey", "part").agg(F.sum("size").alias("n")).select("skey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(bases, ["skey", "part"]).select("doc_id", "t", "r", "skey", "size", (F.col("at") + F.col("base")).alias("offset"))


class Plan:
    """What follows from the sizes of the sources alone."""

    def __init__(self, sizes: dict[str, int], share: float, passes: int, block: int):
        self.names = sorted(sizes)
        self.sizes, self.targets = sizes, targets(sizes, share, passes)
        self.blocks = np.array([-(-sizes[s] // block) for s in self.names], np.int64)
        mean = np.array([max(sizes[s], 1) for s in self.names]) / np.maximum(self.blocks, 1)
        want = np.array([self.targets[s] for s in self.names]) / mean
        self.slots = np.minimum(np.rint(want).astype(np.int64), passes * self.blocks)


def slots(spark: SparkSession, plan: Plan, seed: int, per_shard: int = SLOTS) -> DataFrame:
    """``(shard, slot, skey, block, pass)`` for every slot of the output."""
    total = int(plan.slots.sum())
    shards = -(-total // per_shard)
    if not total:
        return spark.createDataFrame([], "shard long, slot long, skey string, block long, pass int")
    chance = plan.slots / total

    def draw(source):
        for batch in source:
            for shard in batch.column("id").to_pylist():
                room = min(per_shard, total - shard * per_shard)
                counts = np.random.default_rng([seed, shard]).multinomial(room, chance)
                some = np.flatnonzero(counts)
                yield table(["shard", "s", "n"], [pa.array([shard] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())])

    drawn = staged(spark.range(shards).mapInArrow(draw, "shard long, s int, n long"), "mix-drawn")
    got = np.zeros(len(plan.names), np.int64)
    for row in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect():
        got[row.s] = row.n
    surplus, short = np.maximum(got - plan.slots, 0), np.maximum(plan.slots - got, 0)
    over, lack = np.cumsum(surplus) - surplus, np.cumsum(short)
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = drawn.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    names, blocks, exact = np.array(plan.names, object), plan.blocks, plan.slots

    def expand(source):
        for batch in source:
            for shard, draws in zip(batch.column("shard").to_pylist(), batch.column("draws").to_pylist(), strict=True):
                s = np.repeat([d["s"] for d in draws], [d["n"] for d in draws])
                j = np.concatenate([np.arange(d["from"], d["from"] + d["n"]) for d in draws])
                beyond = np.flatnonzero(j >= exact[s])
                rank = over[s[beyond]] + j[beyond] - exact[s[beyond]]
                to = np.searchsorted(lack, rank, "right")
                s[beyond] = to
                j[beyond] = got[to] + rank - (lack[to] - short[to])
                turn = j // blocks[s]
                at = np.empty(len(j), np.int64)
                order = np.lexsort((turn, s))
                new = np.flatnonzero(np.diff(s[order]) | np.diff(turn[order])) + 1
                for mine in np.split(order, new):
                    one, now = int(s[mine[0]]), int(turn[mine[0]])
                    at[mine] = permuted(j[mine] % blocks[one], int(blocks[one]), seed + 1_000_003 * one + now)
                place = np.random.default_rng([seed + 1, shard]).permutation(len(j))
                yield table(["shard", "slot", "skey", "block", "pass"], [
                    pa.array([shard] * len(j), pa.int64()), pa.array(place, pa.int64()), pa.array(names[s], pa.string()),
                    pa.array(at, pa.int64()), pa.array(turn, pa.int32()),
                ])

    per = begun.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("s", "from", "n"))).alias("draws"))
    return per.mapInArrow(expand, "shard long, slot long, skey string, block long, pass int")


def mixed(
    docs: DataFrame, share: float = 1.5, passes: int = 2, block: int = 128, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False,
) -> tuple[DataFrame, DataFrame, Plan]:
    """Stream places of all rows, the slots of the mix, and the plan behind them."""
    placed = staged(streams(docs, id_col, text_col, source_col, whole), "mix-placed")
    sizes = {r.skey: r.n for r in placed.groupBy("skey").agg(F.sum("size").alias("n")).collect()}
    plan = Plan(sizes, share, passes, block)
    return placed, staged(slots(docs.sparkSession, plan, seed), "mix-slots"), plan


def pieces(placed: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """One row per document, block and pass: the words ``low`` to ``high`` (exclusive) of the document."""
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    held = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), last)))
    low = F.greatest(F.col("block") * block, "offset") - F.col("offset")
    high = F.least((F.col("block") + 1) * block, F.col("offset") + F.col("size")) - F.col("offset")
    # never broadcast: Spark takes ``held`` to have as many rows as ``placed``
    return held.join(drawn.select("skey", "block", "pass").hint("merge"), ["skey", "block"]).select(
        "doc_id", "t", "r", "skey", "offset", "pass", low.alias("low"), high.alias("high")
    )


def taken_words(docs: DataFrame, block: int = 128, **how) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` per row."""
    placed, drawn, plan = mixed(docs, block=block, **how)
    rows = [(s, plan.sizes[s], float(plan.targets[s])) for s in plan.names]
    known = docs.sparkSession.createDataFrame(rows, "skey string, source_size long, target double")
    taken = pieces(placed, drawn, block).groupBy("skey", "offset").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    # documents without words share an offset with their successor
    joined = placed.join(taken, ["skey", "offset"], "left").withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return joined.join(known, "skey").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: one per document and pass, ``text`` cut to what was drawn.

    Drawn words keep the white space between them; a newline stands where words were left
    out. Other columns are unchanged. Every row has draws of its own, equal rows too; rows
    that differ in any column are told apart by a hash of all columns.
    """
    placed, drawn, _ = mixed(docs, block=block, id_col=id_col, text_col=text_col, source_col=source_col, whole=True, **how)
    cuts = (
        pieces(placed, drawn, block)
        .groupBy("doc_id", "r", "skey", "offset", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("__cuts"))
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("r").alias("__r"), F.col("skey").alias("__skey"), "__cuts")
    )
    source = F.col(source_col).cast("string")
    # one key without nulls for both steps, so that texts are shuffled once
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__r", row_hash(docs)).withColumn("__skey", F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)))
    key = ["__id", "__r", "__skey"]
    joined = keyed.dropDuplicates(key).join(cuts, key).drop(*key)
    names = docs.columns

    def cut(source):
        for batch in parts(source, text_col):
            out = []
            data, offs = utf8(batch.column(text_col))
            s, e, first = spans(data, offs)
            raw = data.tobytes()
            for k, cuts_ in enumerate(batch.column("__cuts").to_pylist()):
                runs: list[list[int]] = []
                for c in cuts_:
                    if runs and runs[-1][1] == c["low"]:
                        runs[-1][1] = c["high"]
                    else:
                        runs.append([c["low"], c["high"]])
                base = int(first[k])
                out.append(b"\n".join(raw[s[base + a] : e[base + b - 1]] for a, b in runs).decode())
            cols = [pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield table(names, cols)

    return joined.mapInArrow(cut, docs.schema)
