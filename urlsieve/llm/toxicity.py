"""Operator 4: toxicity as significant passages of token log-odds.

Learning. A unit is a lower-cased token (a run of letters, digits and non-ASCII bytes) or one
of its byte prefixes, so that forms of a stem share evidence. Units are counted by document
over the distinct labelled texts of the fitting folds. A unit is a candidate if its counts
differ from the base rate by a binomial likelihood ratio that stands a Bonferroni correction
over all units and its log-odds reach ``odds_least``: in many texts the smallest slant is certain
but tells nothing. As near copies repeat whole neighbourhoods, candidates are tested again by
their distinct contexts (token before, token after). Log-odds have an informative Dirichlet
prior, proportional to the unit's rate in all texts; the lexicon holds the ``lexicon`` most
certain units at most (a parameter, it bounds what is broadcast).

Scoring. A token counts as the best of its units, any other token costs ``cost``. One linear
scan finds all maximal scoring segments. The score S of a segment among n tokens becomes the
normalised score ``lambda S - ln(K n)`` of extreme-value statistics, with lambda and K from
the token rates of clean texts; the positive ones add up to the document's evidence, which a
logistic curve, fitted on a fold of its own, turns into a probability.

Nulls are empty texts; these score as any text without evidence. Labels other than 0 and 1
and labels of unknown documents are left out; of several labels for one id the largest
counts. Texts of any length are scanned whole. Without labels of both kinds nothing is toxic and all scores are 0. Equal texts get
equal scores. Only id and text are read, further columns pass through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.store import fold_of, parts, staged, table, tidy
from urlsieve.llm.text import LOWER, distinct, mix, owners, spans, utf8, word_hashes

APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = False
PREFIXES = (4, 5, 6, 7, 8, 9)
WIDTH = 0.05


@dataclass
class Model:
    """What scoring needs: a bounded lexicon and a few numbers."""

    units: np.ndarray
    odds: np.ndarray
    cost: float
    lam: float
    k: float
    curve: tuple[float, float]
    threshold: float


def units_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every token's units, one column per kind (0: no such unit), and first tokens."""
    data, offs = utf8(batch.column("text"))
    data = LOWER[data]
    s, e, first = spans(data, offs, APART)
    kinds = [word_hashes(data, s, e)]
    for p in PREFIXES:
        h = word_hashes(data, s, np.minimum(s + p, e)) ^ np.uint64(0x5851F42D4C957F2D)
        kinds.append(np.where(e - s >= p, h, np.uint64(0)))
    return np.stack(kinds, axis=1), first


def unit_counts(rows: DataFrame) -> DataFrame:
    """Documents of either label that hold a unit: ``(unit, toxic, clean)``, summed per batch only."""

    @tidy
    def run(source):
        for batch in parts(source, "text", 1 << 20):
            units, first = units_of(batch)
            label = np.asarray(batch.column("toxic").to_pylist(), np.int64)
            owner = np.repeat(owners(first), units.shape[1])
            values, code = distinct(units.reshape(-1))
            pair = np.unique(owner.astype(np.int64) * (len(values) + 1) + code)
            code, toxic = pair % (len(values) + 1), label[pair // (len(values) + 1)]
            yes = np.bincount(code, weights=toxic, minlength=len(values)).astype(np.int64)
            no = np.bincount(code, weights=1 - toxic, minlength=len(values)).astype(np.int64)
            real = values != 0
            yield table(["unit", "toxic", "clean"], [pa.array(values[real].view(np.int64)), pa.array(yes[real]), pa.array(no[real])])

    return rows.select("text", "toxic").mapInArrow(run, "unit long, toxic long, clean long")


def lookup(model: Model, units: np.ndarray) -> np.ndarray:
    """The best log-odds of each token's units, 0 where none is in the lexicon."""
    if not len(model.units) or not len(units):
        return np.zeros(len(units))
    values, code = distinct(units.reshape(-1))
    at = np.minimum(np.searchsorted(model.units, values), len(model.units) - 1)
    odds = np.where(model.units[at] == values, model.odds[at], 0.0)
    return odds[code].reshape(units.shape).max(axis=1)


def maximal_segments(places: list[int], gains: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a text, as (first token, last token, score).

    ``places`` are the tokens with a positive score, all others cost ``cost``. Each candidate
    knows the nearest one to its left that begins lower, so that no chain is walked twice.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, left neighbour
    total, done = 0.0, 0
    for place, gain in zip(places, gains, strict=True):
        total -= cost * (place - done)
        low, high, first = total, total + gain, place
        total, done = high, place + 1
        near = len(stack) - 1
        while near >= 0 and stack[near][0] >= low:
            near = stack[near][4]
        while near >= 0 and stack[near][1] < high:
            low, first = stack[near][0], stack[near][2]
            left = stack[near][4]
            del stack[near:]
            near = left
        stack.append((low, high, first, place, near))
    return [(first, last, high - low) for low, high, first, last, _ in stack]


def evidence(model: Model, batch: pa.RecordBatch) -> list[list[tuple[int, int, float]]]:
    """Segments of each text with their normalised scores, the significant ones only."""
    units, first = units_of(batch)
    gain = lookup(model, units)
    hits = np.flatnonzero(gain)
    cut = np.searchsorted(hits, first)
    out: list[list[tuple[int, int, float]]] = []
    for k in range(batch.num_rows):
        found = hits[cut[k] : cut[k + 1]]
        if not len(found):
            out.append([])
            continue
        begin, n = int(first[k]), int(first[k + 1] - first[k])
        noise = np.log(max(model.k * n, 1e-300))
        scored = maximal_segments((found - begin).tolist(), gain[found].tolist(), model.cost)
        out.append([(a, b, v) for a, b, s in scored if (v := model.lam * s - noise) > 0])
    return out


def strengths(model: Model, rows: DataFrame) -> DataFrame:
    """``(toxic, bin, n)``: how many labelled texts have how much evidence."""

    @tidy
    def run(source):
        for batch in parts(source, "text"):
            x = [np.log1p(sum(v for _, _, v in segments)) for segments in evidence(model, batch)]
            yield table(["toxic", "bin"], [batch.column("toxic"), pa.array(np.floor(np.array(x) / WIDTH).astype(np.int32))])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, bin int").groupBy("toxic", "bin").agg(F.count("*").alias("n"))


def logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Curve through binned counts by Newton's method with a weak ridge."""
    design = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (toxic - (toxic + clean) * p) - 1e-2 * beta
        bend = (design * ((toxic + clean) * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        beta = beta + move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def surprise(t: Column, c: Column, share: float) -> Column:
    """Log-likelihood ratio of t of t + c being toxic against a share of all; negative below it."""
    n = t + c
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    return F.when(t > n * share, 1.0).otherwise(-1.0) * (part(t, share) + part(c, 1 - share))


def contexts(rows: DataFrame, units: np.ndarray) -> DataFrame:
    """``(unit, toxic, clean)``: in how many different neighbourhoods candidates stand."""

    @tidy
    def run(source):
        for batch in parts(source, "text", 1 << 20):
            kinds, first = units_of(batch)
            n = len(kinds)
            if not n:
                continue
            whole = np.concatenate([[np.uint64(0)], kinds[:, 0], [np.uint64(0)]])
            around = mix(whole[:-2] ^ mix(whole[2:]))
            label = np.asarray(batch.column("toxic").to_pylist(), np.int32)[owners(first)]
            at = np.flatnonzero(np.isin(kinds, units).reshape(-1))
            row = at // kinds.shape[1]
            yield table(["unit", "around", "toxic"], [
                pa.array(kinds.reshape(-1)[at].view(np.int64)), pa.array(around[row].view(np.int64)), pa.array(label[row]),
            ])

    found = rows.select("text", "toxic").mapInArrow(run, "unit long, around long, toxic int")
    per = found.groupBy("unit", "around").agg(F.max("toxic").alias("toxic"))
    return per.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def fit(
    docs: DataFrame, labels: DataFrame, folds: tuple[int, int] = (4, 2), prior: float = 0.05, level: float = 1.0,
    odds_least: float = 1.5, lexicon: int = 20_000, cost: float = 0.1, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Lexicon, extreme-value parameters and curve from the labelled rows outside the held-out fold.

    ``folds`` is (number, held-out one) of crc32 of the id; the fold after the held-out one
    fits the curve, the others the lexicon. ``prior`` is the prior's weight as a share of
    the fitting texts, ``level`` the expected number of false units, ``odds_least`` the
    least log-odds of a unit.
    """
    number, held = folds
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    used = fold_of("id", number) != held
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(used)
    rows = rows.withColumn("h", F.xxhash64("text"))
    # copies of a text count once: the first id of each text and fold stands for it. Texts are
    # shuffled once, to their labels, and always: which join is cheaper must not hang on the size
    curve = (fold_of("id", number) == (held + 1) % number).alias("curve")
    marks = rows.select("id", "h", F.octet_length("text").alias("size")).join(known.filter(used).hint("merge"), "id")
    first = marks.groupBy("h", "size", curve).agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"))
    rows = rows.join(first.drop("size").hint("merge"), ["id", "h"]).dropDuplicates(["id", "h"])
    rows = staged(rows.select("text", "toxic", "curve"), "toxic-rows")
    lexical = rows.filter("not curve")
    n_toxic, n_clean = lexical.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    none = Model(np.empty(0, np.uint64), np.empty(0), cost, 1.0, 1.0, (-np.inf, 0.0), threshold)
    if not n_toxic or not n_clean:
        return none
    share = n_toxic / (n_toxic + n_clean)
    weight = prior * (n_toxic + n_clean)
    counts = staged(unit_counts(lexical).groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")), "toxic-units")
    bound = float(np.log(max(counts.count(), 1) / level))
    a = weight * (F.col("t") + F.col("c")) / (n_toxic + n_clean)
    odds = F.log((F.col("t") + a) / (n_toxic + weight - F.col("t") - a)) - F.log((F.col("c") + a) / (n_clean + weight - F.col("c") - a))
    error = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    sure = counts.filter(surprise(F.col("t"), F.col("c"), share) >= bound).select("unit", odds.alias("odds"), (odds / error).alias("z"))
    sure = sure.filter(F.col("odds") >= odds_least)
    top = {r.unit: r.odds for r in sure.orderBy(F.desc("z"), "unit").limit(lexicon).collect()}
    if top:
        apart = contexts(lexical, np.array(sorted(top), np.int64).view(np.uint64))
        kept = apart.filter(surprise(F.col("toxic"), F.col("clean"), share) >= bound).collect()
        top = {r.unit: top[r.unit] for r in kept}
    if not top:
        return none
    units = np.array(list(top), np.int64).view(np.uint64)
    order = np.argsort(units)
    model = Model(units[order], np.array(list(top.values()))[order], cost, 1.0, 1.0, (-np.inf, 0.0), threshold)
    model.lam, model.k = extreme_values(model, lexical.filter("toxic = 0"))
    bins = strengths(model, rows.filter("curve")).collect()
    numbers = sorted({r.bin for r in bins})
    per = {(r.toxic, r.bin): r.n for r in bins}
    x = (np.array(numbers, float) + 0.5) * WIDTH
    toxic, clean = (np.array([per.get((y, b), 0) for b in numbers], float) for y in (1, 0))
    if len(numbers):
        model.curve = logistic(x, toxic, clean)
    return model


def extreme_values(model: Model, clean: DataFrame) -> tuple[float, float]:
    """lambda and K of the score statistics, from how often tokens score in clean texts."""

    @tidy
    def run(source):
        for batch in parts(source, "text"):
            gain = lookup(model, units_of(batch)[0])
            bins, n = np.unique(np.ceil(gain / WIDTH).astype(np.int32), return_counts=True)
            yield table(["bin", "n"], [pa.array(bins), pa.array(n.astype(np.int64))])

    rows = clean.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    seen = {r.bin: r.n for r in rows}
    # half a token more of each score in the lexicon than was seen
    for b in np.unique(np.ceil(model.odds / WIDTH).astype(int)).tolist():
        seen[b] = seen.get(b, 0) + 0.5
    total = sum(seen.values())
    score = np.array([b * WIDTH if b else -model.cost for b in seen])
    rate = np.array(list(seen.values())) / total
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.sum(rate * np.exp(np.minimum(mid * score, 600))) < 1 else (low, mid)
    gains = score > 0
    return high, float(min(1.0, rate[gains].sum() * np.exp(high * score[gains].min()))) if gains.any() else 1.0


def score(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, ...] = ("score", "predicted", "passages")) -> DataFrame:
    """``docs`` with score, prediction and the significant passages (token ranges with their scores)."""
    kept = [f.name for f in docs.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    @tidy
    def run(source):
        for batch in parts(source, text_col):
            texts = pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"])
            segments = evidence(model, texts)
            x = np.log1p([sum(v for _, _, v in s) for s in segments])
            x = (np.floor(x / WIDTH) + 0.5) * WIDTH
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * x))) if np.isfinite(model.curve[0]) else np.zeros(len(x))
            passages = [[{"first": a, "last": b, "score": v} for a, b, v in s] for s in segments]
            yield table([*kept, *names], [
                *batch.columns, pa.array(p), pa.array((p >= model.threshold).astype(np.int32)),
                pa.array(passages, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))),
            ])

    return docs.mapInArrow(run, f"{schema}, {names[0]} double, {names[1]} int, {names[2]} array<struct<first:int,last:int,score:double>>")
