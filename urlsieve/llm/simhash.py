"""Operator 3: SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is cut into a ring of ``SEGMENTS`` segments. If two differ in at
most ``d`` bits, then from some segment on every chain of 1, 2, ... segments stays within
its share ``floor(length * d / SEGMENTS)`` of the differences. For d = 3 and 8 segments the
shares are 0, 0, 1, 1, 1: two equal segments, followed by three of which two are equal. Each
start therefore gives three exact join keys of 32 bits, 24 for a fingerprint, and two
fingerprints within 3 bits share one for certain.

Distinct fingerprints only are compared. Keys are counted with a map-side combine; a key with
more than ``RUN`` fingerprints is dealt into pairs of blocks, so no task holds more than two
blocks of one key. Within a key only links that connect are emitted, not all pairs, since
components are wanted. Documents of a fingerprint are never paired; they meet by its value.

``near_groups`` finds similar word sets by other keys and an exact comparison; see there.

Nulls and texts without words have fingerprint zero. A null id is no candidate for the
smallest id of a group; a group of null ids only has a null ``component_id``. Equal rows
give equal rows. Texts of any length are hashed whole. An empty table gives an empty result.
Only id and text columns are read; ``keep_first`` carries the others, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.components import components
from urlsieve.llm.store import parts, staged, table
from urlsieve.llm.text import mix

SEGMENTS = 8
RUN = 1024
SHORT = 16
#: sets of fewer shingles have views of two
FEW = 16
BINS = 64
NO_ID = 2**63 - 1
TO_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` lower-cased words, repeats included."""
    words = text.translate(TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(words) - width + 1)


def bin_counts(known: np.ndarray) -> bytes:
    """How many distinct shingles fall into each of ``BINS`` bins, 255 at most."""
    return np.minimum(np.bincount((known % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a : a + (1 << 14)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """The 24 join keys of each fingerprint: 8 starts x 3 choices of the segment that may differ."""
    seg = [(fps >> np.uint64(8 * i)) & np.uint64(255) for i in range(SEGMENTS)]
    keys = []
    for i in range(SEGMENTS):
        chain = [seg[(i + j) % SEGMENTS] for j in range(5)]
        for free in (2, 3, 4):
            fixed = [chain[j] for j in range(5) if j != free]
            key = np.full(len(fps), 3 * i + free - 2, np.uint64)
            for part in fixed:
                key = key << np.uint64(8) | part
            keys.append(key)
    return np.stack(keys, axis=1)


def tree_edges(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected by differences up to ``limit``, the closest first."""
    n, out = len(fps), []
    best = np.full(n, 255, np.int16)
    link = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    now = 0
    for _ in range(n):
        open_[now] = False
        gap = np.bitwise_count(fps ^ fps[now]).astype(np.int16)
        closer = open_ & (gap < best)
        best[closer] = gap[closer]
        link[closer] = now
        left = np.flatnonzero(open_)
        if not len(left):
            break
        now = int(left[np.argmin(best[left])])
        if best[now] <= limit:
            out.append((int(link[now]), now))
        # beyond the limit this starts another tree; what was nearest before stays valid
    return out


def run_links(key: np.ndarray, ids: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (already sorted)."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(edge, len(key)))
    a, b = [], []
    place = np.arange(len(key)) - np.repeat(edge, size)
    short = np.repeat((size > 1) & (size <= SHORT), size)
    for shift in range(1, SHORT):
        i = np.flatnonzero(short[shift:] & (place[shift:] >= shift)) + shift
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i - shift]) <= limit]
        a.append(ids[i - shift])
        b.append(ids[i])
    for s, n in zip(edge[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        for x, y in tree_edges(fps[s : s + n], limit):
            a.append(ids[[s + x]])
            b.append(ids[[s + y]])
    none = np.empty(0, np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def linked(keyed: DataFrame, limit: int) -> DataFrame:
    """Links ``(a, b)`` among rows ``(key, leader, fp)`` that share a key and differ in up to ``limit`` bits."""
    # never broadcast: Spark takes ``keyed`` to have as many rows as what its keys were made from
    sizes = keyed.groupBy("key").count().filter("count > 1").hint("merge")
    blocks = F.ceil(F.col("count") / RUN).cast("int")
    rows = keyed.join(sizes, "key").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp", "leader"), "blocks").cast("int")
    spread = rows.select(
        "key", "leader", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("key", "leader", "fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("run"))
    sorted_ = spread.repartition("run").sortWithinPartitions("run", "leader")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def links(cols):
            a, b = run_links(cols[0], cols[1], cols[2].view(np.uint64), limit)
            return table(["a", "b"], [pa.array(a, pa.int64()), pa.array(b, pa.int64())])

        for batch in source:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "leader", "fp")]
            if kept is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(kept, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on in the next batch
            kept = [c[cut:] for c in cols]
            if cut:
                yield links([c[:cut] for c in cols])
        if kept is not None and len(kept[0]):
            yield links(kept)

    return sorted_.select("run", "leader", "fp").mapInArrow(run, "a long, b long")


def fingerprints(rows: DataFrame, width: int = 3) -> DataFrame:
    """The columns of ``rows`` (longs) with ``fp``, the 64 bits as a long, in the place of ``text``."""
    keys = [c for c in rows.columns if c != "text"]

    def run(source):
        for batch in parts(source, "text"):
            fps = [fingerprint(shingle_hashes((t or "").encode(), width)) for t in batch.column("text").to_pylist()]
            yield table([*keys, "fp"], [*(batch.column(c) for c in keys), pa.array(np.array(fps, np.uint64).view(np.int64))])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*keys, "fp")))


def with_ring_keys(leaders: DataFrame) -> DataFrame:
    def run(source):
        for batch in source:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            keys = ring_keys(fps)
            many = keys.shape[1]
            yield table(["key", "leader", "fp"], [
                pa.array(keys.reshape(-1).view(np.int64)),
                pa.array(np.repeat(batch.column("leader").to_numpy(zero_copy_only=False), many)),
                pa.array(np.repeat(fps.view(np.int64), many)),
            ])

    return leaders.select("leader", "fp").mapInArrow(run, "key long, leader long, fp long")


def simhash_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row: groups linked by 3 or fewer differing bits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = staged(fingerprints(rows, width), "simhash-fps")
    return fps.join(least_of_components(fps, F.coalesce("doc_id", F.lit(NO_ID))), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("least") != NO_ID, F.col("least")).alias("component_id"),
    )


def least_of_components(fps: DataFrame, order: Column) -> DataFrame:
    """``(fp, least)`` of every distinct fingerprint: the least ``order`` among the rows of its component."""
    leaders = staged(fps.groupBy("fp").agg(F.min(order).alias("first")), "simhash-leaders")
    # distinct fingerprints name the nodes; their smallest ids come in afterwards, null ids included
    named = leaders.select(F.col("fp").alias("leader"), "fp", "first")
    roots = components(linked(with_ring_keys(named), 3))
    placed = named.join(roots, F.col("leader") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return staged(placed.join(least, "root").select("fp", "least"), "simhash-groups")


def simhash_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, t, first_id, first_t)``: documents and the first document of the component of each, as ``near_groups`` names them."""
    fps = staged(fingerprints(docs.select(*keyed(id_col, text_col)), width), "simhash-fps")
    tops = least_of_components(fps, F.struct("id", "t"))
    return fps.join(tops, "fp").select("id", "t", F.col("least.id").alias("first_id"), F.col("least.t").alias("first_t"))


def view_keys(known: np.ndarray, seeds: np.ndarray, sample: int) -> np.ndarray:
    """A key for each seed: hash of the ``sample`` members that come first in the seed's order."""
    out = []
    step = max(1, (1 << 20) // len(known))
    for a in range(0, len(seeds), step):
        order = mix(known[None, :] ^ seeds[a : a + step, None])
        if order.shape[1] > sample:
            order = np.partition(order, sample - 1, axis=1)[:, :sample]
        order.sort(axis=1)
        out += [xxhash.xxh64_intdigest(row.tobytes(), 1000 * sample + a + v) for v, row in enumerate(order)]
    return np.array(out, np.uint64).view(np.int64)


def near_groups(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, views: int = 20, sample: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, t, first_id, first_t)``: documents and the first document of the group of each.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is
    at least ``similarity``. At 0.8 two whole-text fingerprints differ in about ten bits,
    which no index prunes; so the keys are ``views`` further SimHashes, each over the
    ``sample`` shingles that come first in an order of its own: a view of four shingles agrees
    with probability 0.8^4, one of twenty views with 0.99997, while texts that share a passage but
    little else hardly ever agree in four. Sets of fewer than ``FEW`` shingles have views of two;
    sets of a size between have both kinds, so that any two that are similar share a kind. Candidates that share a view are
    compared by their whole shingle sets, see ``near_components``; bin counts of the sets only
    spare pairs that cannot be similar. Documents with the same words are one node.

    A document is known by its id (null: ``NO_ID``, after all others) and a hash of its text.
    """

    def signatures(source):
        seeds = mix(np.arange(1, views + 1, dtype=np.uint64))
        high = int(FEW / similarity) + 2
        for batch in parts(source, "text"):
            size, bins, digest, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                hashes = shingle_hashes(raw, width)
                digest.append(hashlib.blake2b(b" ".join(raw.translate(TO_LOWER).split()), digest_size=16).hexdigest())
                known = np.unique(hashes)
                size.append(len(known))
                bins.append(bin_counts(known))
                kinds = [k for k, fits in ((2, 0 < len(known) < high), (sample, len(known) >= FEW)) if fits]
                keys.append(np.concatenate([np.empty(0, np.int64), *(view_keys(known, seeds, k) for k in kinds)]))
            yield table(["id", "t", "words", "size", "bins", "keys"], [
                batch.column("id"), batch.column("t"), pa.array(digest, pa.string()),
                pa.array(size, pa.int64()), pa.array(bins, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ])

    rows = docs.select(*keyed(id_col, text_col))
    signed = staged(rows.mapInArrow(signatures, "id long, t long, words string, size long, bins binary, keys array<long>"), "near-signed")
    # one node per word sequence, named by a hash of its digest
    nodes = signed.groupBy("words").agg(F.min(F.struct("id", "t")).alias("first"), *(F.first(c).alias(c) for c in ("size", "bins", "keys")))
    nodes = staged(nodes.select(F.xxhash64("words").alias("leader"), "words", "first", "size", "bins", "keys"), "near-nodes")

    def sets(leaders: DataFrame) -> DataFrame:
        return shingle_sets(rows.join(nodes.join(leaders, "leader").select("leader", "first.id", "first.t"), ["id", "t"]), width)

    roots = near_components(nodes, sets, similarity)
    placed = nodes.join(roots, F.col("leader") == F.col("node"), "left").select("words", "first", F.coalesce("root", "leader").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("top"))
    group = staged(placed.join(least, "root").select("words", F.col("top.id").alias("first_id"), F.col("top.t").alias("first_t")), "near-tops")
    return signed.select("id", "t", "words").join(group, "words").select("id", "t", "first_id", "first_t")


def near_components(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``(node, root)``: the components of nodes ``(leader, size, bins, keys)`` by similar sets.

    Within a key every member is compared with the most central one first, the one whose keys
    hold most documents. What is verified joins its component, and the next turn compares the
    following members, by rising hash and four times as many each turn, with all later members
    of other components. A key leaves when its members are one component or every member had
    its turn; so any two that share a key are compared unless they are connected already.
    """
    spread = nodes.select(F.explode("keys").alias("key"), "leader")
    sizes = spread.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    common = staged(spread.join(sizes, "key"), "near-common")
    weight = common.groupBy("leader").agg(F.sum("many").alias("weight"))
    live = common.join(weight.join(nodes.select("leader", "size", "bins"), "leader"), "leader")
    live = staged(live.withColumn("root", F.col("leader")), "near-live")
    bearers = staged(sets(weight.select("leader")), "near-sets")
    place = F.col("leader") / F.lit(2.0**64) + 0.5
    centre = F.max(F.struct("weight", "leader"))["leader"]
    roots, turn = components(nodes.select(F.col("leader").alias("a"), F.col("leader").alias("b")).limit(0)), 0
    while not live.isEmpty():
        if not turn:
            pivots = live.join(live.groupBy("key").agg(centre.alias("centre")), "key").filter("leader = centre")
            apart = F.lit(True)
        else:
            pivots = live.filter((place >= turned(turn - 1)) & (place < turned(turn)))
            apart = F.col("leader") > F.col("a")
        pivots = pivots.select("key", F.col("leader").alias("a"), F.col("root").alias("r"), F.col("size").alias("n"), F.col("bins").alias("c"))
        met = live.join(pivots, "key").filter((F.col("root") != F.col("r")) & apart)
        met = met.select(F.least("a", "leader").alias("a"), F.greatest("a", "leader").alias("b"), (F.col("size") + F.col("n")).alias("n"), "bins", "c")
        pairs = staged(may_be_close(met, similarity).distinct(), "near-pairs")
        both = pairs.join(bearers.toDF("a", "left"), "a").join(bearers.toDF("b", "right"), "b")
        shared = F.size(F.array_intersect("left", "right"))
        close = staged(both.filter(shared >= similarity * (F.size("left") + F.size("right") - shared)).select("a", "b"), "near-close")
        if not close.isEmpty():
            roots = components(close.union(roots.toDF("a", "b")))
            live = live.drop("root").join(roots, F.col("leader") == F.col("node"), "left").drop("node")
            live = live.withColumn("root", F.coalesce("root", "leader"))
        several = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        live = staged(live.join(several.select("key"), "key").filter(turned(turn) < 1), "near-live")
        turn += 1
    return roots


def may_be_close(met: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of the pairs that can reach ``similarity``; no other pair does.

    Sets of ``n`` members together differ in at most ``n * (1 - similarity) / (1 + similarity)``
    of them, and the counts of their bins in no more.
    """
    share = (1 - similarity) / (1 + similarity)

    def run(source):
        for batch in source:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bins", "c"))
            gap = np.abs(left.astype(np.int16) - right).sum(axis=1)
            close = pa.array(gap <= batch.column("n").to_numpy() * share + 1e-6)
            yield batch.select(["a", "b"]).filter(close)

    return met.mapInArrow(run, "a long, b long")


def turned(turns: int) -> Column:
    """The share of a key's members that had their turn after ``turns``: 2, 10, 42, ... members, all of a short key."""
    if not turns:
        return F.lit(0.0)
    return F.when(F.col("many") <= SHORT, 1.0).otherwise(2 * (4**turns - 1) / 3 / F.col("many"))


def keyed(id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
        F.col(text_col).alias("text"),
    ]


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """``(leader, shingles)``: the distinct shingle hashes of each document, once."""

    def run(source):
        for batch in parts(source, "text"):
            sets = [np.unique(shingle_hashes((t or "").encode(), width)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield table(["leader", "shingles"], [batch.column("leader"), pa.array(sets, pa.list_(pa.int64()))])

    return rows.select("leader", "text").mapInArrow(run, "leader long, shingles array<long>").dropDuplicates(["leader"])


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] | None = None, **how
) -> DataFrame:
    """The first document of every group of ``groups`` (``near_groups``), one row each, columns unchanged.

    First is the smallest id, then the smallest text hash; of rows equal in id and text the
    first by the other columns, in their order, stays.
    """
    names = docs.columns
    found = (groups or near_groups)(docs, id_col=id_col, text_col=text_col, **how)
    first = found.select(F.col("first_id").alias("__id"), F.col("first_t").alias("__t")).distinct()
    own_id, own_t, _ = keyed(id_col, text_col)
    rows = docs.withColumn("__id", own_id).withColumn("__t", own_t)
    # not a window: rows of one id and text fold before they are shuffled
    others = F.struct(*[F.col(f"`{n}`") for n in names])
    kept = rows.join(first, ["__id", "__t"]).groupBy("__id", "__t").agg(F.min(others).alias("__row"))
    return kept.select(*[F.col("__row").getField(n).alias(n) for n in names])
