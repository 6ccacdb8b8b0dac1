"""Operator 7: substring dedup over a token de Bruijn graph.

Edges are runs of ``k`` words. Only edges that can repeat become rows:

1. Each edge has an anchor, the smallest hash among its runs of ``ANCHOR`` words. Equal edges
   have equal anchors, so an edge whose anchor occurs once is unique. Anchors are a seventh
   of the positions; they are counted with a map-side combine and joined back. Documents with
   the same words are one document here: only the first stays in the graph.
2. Edges at repeated anchors become rows ``(edge, check, place)``. Their first place, the
   *source coordinate*, and their count are joined back to every occurrence. ``check`` is a
   second, independent hash: 96 bits have to agree at both coordinates.
3. Paths: successive edges of a document with the same count and successive source
   coordinates form a nonbranching run, which compacts to one row ``(place, edges, source,
   copies)``.

Removal takes every word that an edge covers whose source is not itself.

Tables with a row per document, anchor, edge or path meet in merge joins at any size: as a
broadcast, their rows and lists take many times the room of the files that Spark judges by.

Nulls are empty texts. A null id comes before all others. Rows equal in id and text are one
document and each is returned; texts under one id are ordered by their hash. Texts of fewer
than ``k`` words lose nothing, those of any length are cut whole. An empty table gives an empty result. Only the id and the text column are
read, so that other columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.store import drop_staged, parts, positioned, staged, table
from urlsieve.llm.text import spans, utf8, window_hashes, word_hashes

ANCHOR = 8
NO_ID = -(2**63)
KEY = ["id", "t"]


def keyed(id_col: str, text_col: str) -> list[Column]:
    """Internal key, id (null first) and a hash of the text, besides the text."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
        F.col(text_col).alias("text"),
    ]


def edge_anchors(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a batch (their first words), the anchor position of each, and all run hashes."""
    width = k - ANCHOR + 1
    runs = window_hashes(hashes, ANCHOR, 2)
    if len(hashes) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64), runs
    starts = np.arange(len(hashes) - k + 1)
    starts = starts[starts + k <= np.repeat(first[1:], np.diff(first))[: len(starts)]]
    if not len(starts):
        return starts, starts, runs
    low = sliding_min(runs, width)[starts]
    return starts, leftmost(runs, low, starts, width), runs


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` entries, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def leftmost(runs: np.ndarray, low: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Place of the first run equal to each edge's minimum."""
    at = np.empty(len(starts), np.int64)
    todo = np.arange(len(starts))
    for shift in range(width):
        hit = runs[starts[todo] + shift] == low[todo]
        at[todo[hit]] = starts[todo[hit]] + shift
        todo = todo[~hit]
    return at


def anchors(rows: DataFrame, k: int) -> DataFrame:
    """One row per document: count and hash of its words, its anchors' hashes."""

    def run(source):
        for batch in parts(source, "text", 1 << 20):
            data, offs = utf8(batch.column("text"))
            s, e, first = spans(data, offs)
            hashes = word_hashes(data, s, e)
            starts, at, runs = edge_anchors(hashes, first, k)
            places = np.unique(at)
            owner = np.searchsorted(first, places, "right") - 1
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            raw, bounds = data.tobytes(), offs.tolist()
            digest = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(bounds, bounds[1:])]
            yield table(["id", "t", "n_words", "words", "anchor"], [
                batch.column("id"), batch.column("t"), pa.array(np.diff(first), pa.int64()), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(runs[places].view(np.int64))),
            ])

    return rows.mapInArrow(run, "id long, t long, n_words long, words binary, anchor array<long>")


def edges(rows: DataFrame, k: int) -> DataFrame:
    """Edges whose anchor is among the row's ``repeated`` ones; adjacent equal rows count once."""

    def run(source):
        before = None
        for batch in parts(source, "text", 1 << 20):
            keys = list(zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True))
            new = [a != b for a, b in zip(keys, [before, *keys], strict=False)]
            before = keys[-1]
            batch = batch.filter(pa.array(new))
            data, offs = utf8(batch.column("text"))
            s, e, first = spans(data, offs)
            hashes = word_hashes(data, s, e)
            starts, at, runs = edge_anchors(hashes, first, k)
            wanted = batch.column("repeated").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = starts[np.isin(runs[at], np.unique(wanted))]
            owner = np.searchsorted(first, starts, "right") - 1
            yield table(["edge", "check", "base", "start"], [
                pa.array(window_hashes(hashes, k, 3)[starts].view(np.int64)),
                pa.array((window_hashes(hashes_again(data, s, e), k, 4)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                batch.column("base").take(pa.array(owner)),
                pa.array((starts - first[owner]).astype(np.int32)),
            ])

    return rows.mapInArrow(run, "edge long, check int, base long, start int")


def hashes_again(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word hashes that are independent of the first ones."""
    return word_hashes(data, starts, ends, 7)


def repeated_paths(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nonbranching paths of repeated edges at every place where they occur.

    Returns ``(base, start, edges, source, copies, is_source)`` and the documents
    ``(id, t, stays, base)``. ``base`` is the number of words in all documents before, so
    that ``base + start`` is a place in the corpus, as ``source`` is. A document with
    ``stays`` false has the words of an earlier one; it has no base.
    """
    rows = docs.select(*keyed(id_col, text_col))
    seen = staged(anchors(rows, k).dropDuplicates(KEY), "debruijn-anchors")
    first_of = seen.groupBy("words", "n_words").agg(F.min(F.struct(*KEY)).alias("first"))
    listed = seen.select(*KEY, "words", "n_words").join(first_of.hint("merge"), ["words", "n_words"])
    listed = staged(listed.select(*KEY, "n_words", (F.struct(*KEY) == F.col("first")).alias("stays")), "debruijn-listed")
    bases = staged(positioned(listed.filter("stays").select(*KEY, "n_words"), KEY, "n_words", "base").select(*KEY, "base"), "debruijn-bases")
    spread = staged(seen.select(*KEY, "anchor").join(bases.hint("merge"), KEY).select("base", F.explode("anchor").alias("anchor")), "debruijn-spread")
    drop_staged(seen)
    common = staged(spread.groupBy("anchor").count().filter("count > 1").select("anchor"), "debruijn-common")
    where = staged(spread.join(common.hint("merge"), "anchor").groupBy("base").agg(F.collect_list("anchor").alias("repeated")), "debruijn-where")
    drop_staged(spread, common)
    wanted = bases.join(where.hint("merge"), "base")
    found = staged(edges(rows.join(wanted.hint("merge"), KEY), k), "debruijn-edges")
    drop_staged(where)
    place = F.col("base") + F.col("start")
    sources = found.groupBy("edge", "check").agg(F.min(place).alias("source"), F.count("*").alias("copies")).filter("copies > 1")
    sources = staged(sources, "debruijn-sources")
    met = staged(found.join(sources.hint("merge"), ["edge", "check"]).select("base", "start", "source", "copies"), "debruijn-met")
    drop_staged(found, sources)
    order = Window.partitionBy("base").orderBy("start")
    joins = (
        (F.col("start") == F.lag("start").over(order) + 1)
        & (F.col("copies") == F.lag("copies").over(order))
        & (F.col("source") == F.lag("source").over(order) + 1)
    )
    runs = met.withColumn("head", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("head").over(order))
    paths = runs.groupBy("base", "run").agg(
        F.min("start").alias("start"), F.count("*").cast("int").alias("edges"), F.min("source").alias("source"), F.first("copies").alias("copies")
    )
    paths = staged(paths.select("base", "start", "edges", "source", "copies", (place == F.col("source")).alias("is_source")), "debruijn-paths")
    drop_staged(met)
    return paths, listed.join(bases.hint("merge"), KEY, "left").select(*KEY, "stays", "base")


def drop_repeats(
    docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), output: str = "words"
) -> DataFrame:
    """Every row with the words that stay: id, ``carry``, ``n_words``, ``n_removed`` and the output column.

    ``output`` is ``words`` (column ``kept``: the words joined by one space), ``digest``
    (``kept_sha256``: sha256 of that) or ``text`` (``text``: the text itself where nothing
    goes, otherwise its runs of kept words as they stood, joined by one space). ``carry``
    names further columns of ``docs`` to return unchanged.
    """
    paths, listed = repeated_paths(docs, k, id_col, text_col)
    gone = paths.filter("not is_source").groupBy("base").agg(F.collect_list(F.struct("start", "edges")).alias("gone"))
    # documents without a base (copies) stay out of that join: they would all meet at null
    first = listed.filter("stays").join(gone.hint("merge"), "base", "left")
    copies = listed.filter("not stays").withColumn("gone", F.lit(None).cast(first.schema["gone"].dataType))
    state = staged(first.unionByName(copies).drop("base"), "debruijn-state")
    also = [F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)]
    joined = docs.select(F.col(id_col).alias("__id"), *also, *keyed(id_col, text_col)).join(state.hint("merge"), KEY)
    named = [f"__carry_{i}" for i in range(len(carry))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select("__id", *named).schema)
    last = {"words": "kept", "digest": "kept_sha256", "text": "text"}[output]

    def staying(n: int, stays: bool, gone_: list | None) -> np.ndarray:
        """Which of a text's words stay."""
        if n < k:  # such a text has no edge; one without words shares its successor's base
            return np.ones(n, bool)
        if not stays:
            return np.zeros(n, bool)
        change = np.zeros(n + 1, np.int32)
        for g in gone_ or ():
            change[g["start"]] += 1
            change[g["start"] + g["edges"] - 1 + k] -= 1
        return np.cumsum(change[:-1]) == 0

    def kept_text(text: str | None, stay: np.ndarray) -> str | None:
        if stay.all():
            return text
        raw = text.encode()
        s, e, _ = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        change = np.flatnonzero(np.diff(np.concatenate([[False], stay, [False]]).astype(np.int8)))
        return b" ".join(raw[s[a] : e[b - 1]] for a, b in zip(change[::2], change[1::2], strict=True)).decode()

    def run(source):
        for batch in parts(source, "text"):
            counts, removed, kept = [], [], []
            texts, stays, gones = (batch.column(c).to_pylist() for c in ("text", "stays", "gone"))
            for text, first, gone_ in zip(texts, stays, gones, strict=True):
                words = (text or "").encode().split()
                stay = staying(len(words), first, gone_)
                counts.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                if output == "text":
                    kept.append(kept_text(text, stay))
                    continue
                whole = b" ".join(words if not removed[-1] else [w for w, s in zip(words, stay.tolist(), strict=True) if s])
                kept.append(hashlib.sha256(whole).hexdigest() if output == "digest" else whole.decode())
            yield table(["__id", *named, "n_words", "n_removed", last], [
                batch.column("__id"), *(batch.column(c) for c in named),
                pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
            ])

    out = joined.mapInArrow(run, f"{schema}, n_words long, n_removed long, {last} string")
    return out.select(F.col("__id").alias(id_col), *(F.col(n).alias(c) for n, c in zip(named, carry, strict=True)), "n_words", "n_removed", last)
