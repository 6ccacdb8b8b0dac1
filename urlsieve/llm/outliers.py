"""Operator 5: quality rules with robust multivariate outliers.

Plain counts of a text are turned into a vector of five: logarithm of the word count, mean
word length, and square roots of the shares of symbols, repeated lines and repeated words,
the shares drawn towards the group's own (or zero) for short texts. For each language and
source a minimum-covariance-determinant estimate gives centre and scatter: from three starts,
concentration steps repeat "distances, their ``coverage`` quantile per group, moments of the
rows below it" until the determinant no longer falls, and the least one counts. A row is rejected if its squared Mahalanobis distance
to its group exceeds a chi-square quantile. ``FLOOR`` keeps each statistic's scatter above a
least width, since most texts have no symbol and no repeat at all.

Rows that fail a base rule take no part in the fit. A language and source of fewer than
``least`` fitting rows joins the small ones of its language, those of fewer than that the
rest of the table, so each row has exactly one group; if even that is too small, nothing in
it is rejected. Counts, quantiles (mergeable sketches) and moments fold on the map side, so a
group may hold any part of the rows; estimates are one small row per group and start, broadcast
while there are at most ``BROADCAST_ROWS`` of them.

Texts of any length are counted whole. Nulls: a null text has no words and fails the base rule; null languages and sources form
groups of their own. Equal rows get equal results. An empty table gives an empty result.
Only id, text, language and source are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.store import parts, staged, table
from urlsieve.llm.text import SPACE, mix, owners, spans, utf8, window_hashes, word_hashes

STATS = ["x0", "x1", "x2", "x3", "x4"]
#: least standard deviations: log words, log word length, roots of shares of symbols, lines, words
FLOOR = [0.5, 0.05, 0.03, 0.15, 0.1]
GROUP = ["g_lang", "g_source"]
ESTIMATE = "g_lang string, g_source string, start int, centre array<double>, precision array<double>, logdet double"
BROADCAST_ROWS = 20_000
FEW_TASKS = 4
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
RUN = 5


def text_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)``."""

    def run(source):
        for batch in parts(source, "text"):
            data, offs = utf8(batch.column("text"))
            s, e, first = spans(data, offs)
            per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
            lines, repeats = [], []
            raw, bounds = data.tobytes(), offs.tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                full = [x for x in raw[a:b].split(b"\n") if x.split(None, 1)]
                lines.append(len(full))
                repeats.append(len(full) - len(set(full)))
            covered = repeated_words(word_hashes(data, s, e), first)
            yield table(["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"], [
                *(batch.column(c) for c in ("doc_id", "lang", "source")),
                *(pa.array(np.asarray(x, np.int64)) for x in (
                    np.diff(first), per(~SPACE[data] & ((data & 0xC0) != 0x80)), per(SYMBOL[data]), lines, repeats, covered)),
            ])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
    )
    return rows.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = RUN) -> np.ndarray:
    """Per text, words inside runs of ``width`` words that the text has at least twice."""
    runs = window_hashes(hashes, width)
    if not len(runs):
        return np.zeros(len(first) - 1, np.int64)
    owner = owners(first)
    at = np.flatnonzero(owner[: len(runs)] == owner[width - 1 :])
    key = mix(runs[at] ^ mix(owner[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + width, -1)
    inside = np.cumsum(change[:-1]) > 0
    return np.diff(np.concatenate([[0], np.cumsum(inside)])[first])


def chi2_cdf(x: float, p: int) -> float:
    grid = np.linspace(0, np.sqrt(x), 20_001)  # in the root, where the density has no pole
    density = grid ** (p - 1) * np.exp(-(grid**2) / 2)
    whole = np.linspace(0, 40, 200_001)
    return float(np.trapezoid(density, grid) / np.trapezoid(whole ** (p - 1) * np.exp(-(whole**2) / 2), whole))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def distance() -> Column:
    """Squared distance of a row's statistics from ``centre`` under ``precision`` (row-major)."""
    p = len(STATS)
    gap = [F.col(x) - F.col("centre")[i] for i, x in enumerate(STATS)]
    terms = [gap[i] * gap[j] * F.col("precision")[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def precision_of(scatter: np.ndarray) -> tuple[list[float], float]:
    """Inverse (row-major) and log determinant of a scatter matrix whose diagonal is raised by the floors."""
    raised = scatter + np.diag(np.square(FLOOR))
    return list(np.linalg.inv(raised).ravel()), float(np.linalg.slogdet(raised)[1])


def small(df: DataFrame) -> DataFrame:
    """A written table of groups, broadcast where it has few rows: rows then stay where they lie."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def gathered(df: DataFrame, like: DataFrame) -> DataFrame:
    """A result of a row per group in a few tasks where ``like`` has few groups: a task each for a row or none is slow."""
    return df.coalesce(FEW_TASKS) if like.count() <= BROADCAST_ROWS else df


def medians(rows: DataFrame) -> DataFrame:
    """Medians and median deviations of every group as a first estimate."""
    middle = staged(rows.groupBy(*GROUP).agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in STATS)), "mcd-medians")
    spread = rows.join(small(middle), GROUP).groupBy(*GROUP).agg(
        *(F.first(f"m_{x}").alias(f"m_{x}") for x in STATS),
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"d_{x}") for x in STATS),
    )

    def run(source):
        for pdf in source:
            out = pdf[GROUP].copy()
            out["start"] = 0
            out["centre"] = [list(r) for r in pdf[[f"m_{x}" for x in STATS]].to_numpy(float)]
            out["precision"] = [precision_of(np.diag(np.square(1.4826 * r)))[0] for r in pdf[[f"d_{x}" for x in STATS]].to_numpy(float)]
            yield out.assign(logdet=np.inf)

    return gathered(spread, middle).mapInPandas(run, ESTIMATE)


def step(rows: DataFrame, estimate: DataFrame, coverage: float | None, scale: float) -> DataFrame:
    """One concentration step: moments of the ``coverage`` part of each group that lies nearest (of all without one)."""
    p, keys = len(STATS), [*GROUP, "start"]
    near = rows.join(small(estimate), GROUP)
    if coverage is not None:
        near = near.withColumn("d2", distance())
        cut = staged(gathered(near.groupBy(*keys).agg(F.percentile_approx("d2", coverage, 1000).alias("cut")), estimate), "mcd-cut")
        near = near.join(small(cut), keys).filter("d2 <= cut")
    shifted = [F.col(x) - F.col("centre")[i] for i, x in enumerate(STATS)]  # sums around the old centre keep their digits
    moments = near.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("centre").alias("old"),
        F.array(*(F.sum(s) for s in shifted)).alias("s"),
        F.array(*(F.sum(shifted[i] * shifted[j]) for i in range(p) for j in range(p))).alias("ss"),
    )

    def run(source):
        for pdf in source:
            centre, found = [], []
            for n, old, s, ss in zip(pdf["n"], pdf["old"], pdf["s"], pdf["ss"], strict=True):
                mean = np.asarray(s, float) / n
                centre.append(list(np.asarray(old, float) + mean))
                found.append(precision_of((np.asarray(ss, float).reshape(p, p) / n - np.outer(mean, mean)) * scale))
            out = pdf[keys].copy()
            for name, values in (("centre", centre), ("precision", [f[0] for f in found])):
                out[name] = pd.Series(values, index=out.index, dtype=object)
            yield out.assign(logdet=[f[1] for f in found])

    return gathered(moments, estimate).mapInPandas(run, ESTIMATE)


def consistency(coverage: float) -> float:
    """What the scatter of the nearest part is multiplied with: it alone looks too narrow."""
    return coverage / chi2_cdf(chi2_quantile(coverage, len(STATS)), len(STATS) + 2)


def concentrate(rows: DataFrame, coverage: float, most: int) -> DataFrame:
    """The estimate of least determinant for each group, from three starts at once.

    Starts are the medians, the moments of all rows, and those of the half nearest to the
    medians. A step never raises the determinant but for the sketches' error; a group keeps its
    last estimate when it does not fall any more, and steps end when none falls, or after ``most``.
    """
    first = staged(medians(rows), "mcd-start")
    others = [step(rows, first, share, scale).withColumn("start", F.lit(k)) for k, share, scale in ((1, None, 1.0), (2, 0.5, consistency(0.5)))]
    now = first.unionByName(others[0]).unionByName(others[1]).withColumn("logdet", F.lit(np.inf))
    now, scale = staged(now, "mcd-starts"), consistency(coverage)
    for _ in range(most):
        new = step(rows, now, coverage, scale)
        both = new.select(*GROUP, "start", F.struct("logdet", "centre", "precision").alias("new")).join(
            small(now).select(*GROUP, "start", F.struct("logdet", "centre", "precision").alias("old")), [*GROUP, "start"]
        )
        falls = F.col("new.logdet") < F.col("old.logdet") - 1e-9
        chosen = both.select(*GROUP, "start", falls.alias("falls"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("one"))
        now = staged(gathered(chosen.select(*GROUP, "start", "falls", "one.centre", "one.precision", "one.logdet"), now), "mcd-step")
        if now.filter("falls").isEmpty():
            break
        now = now.drop("falls")
    best = F.min_by(F.struct("centre", "precision"), F.struct("logdet", "start")).alias("best")
    return now.groupBy(*GROUP).agg(best).select(*GROUP, "best.centre", "best.precision")


def grouped(rows: DataFrame, least: int) -> DataFrame:
    """Rows with the group each is judged in."""
    whole = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source")]
    rows = rows.withColumn("l", whole[0]).withColumn("s", whole[1])
    fit = (~F.col("base_failed")).cast("long")
    one = rows.groupBy("l", "s").agg(F.sum(fit).alias("n"))
    few = one.filter(F.col("n") < least).groupBy("l").agg(F.sum("n").alias("n_small"))
    named = one.join(few, "l", "left").select(
        "l", "s",
        F.when((F.col("n") >= least) | (F.col("n_small") >= least), F.col("l")).otherwise("*").alias("g_lang"),
        F.when(F.col("n") >= least, F.col("s")).otherwise("*").alias("g_source"),
        "n",
    )
    total = named.groupBy(*GROUP).agg(F.sum("n").alias("fitted"))
    return rows.join(small(staged(named.drop("n").join(total, GROUP), "mcd-groups")), ["l", "s"]).drop("l", "s")


def judge(
    docs: DataFrame, coverage: float = 0.75, quantile: float = 0.999999, least: int = 200, steps: int = 20,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Counts, ``base_failed``, ``d2`` and ``kept`` of every row."""
    counts = text_counts(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = grouped(staged(counts.withColumn("base_failed", failed), "mcd-counts"), least)
    fitting = rows.filter("not base_failed")
    usual = fitting.groupBy(*GROUP).agg(
        (F.sum("word_chars") / F.sum("n_words")).alias("usual_length"), (F.sum("n_symbols") / F.sum("word_chars")).alias("usual_symbols")
    )
    vectors = rows.join(small(staged(usual, "mcd-usual")), GROUP, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "fitted", *GROUP,
        F.log(F.greatest("n_words", F.lit(1))).alias("x0"),
        F.log((F.col("word_chars") + 50 * F.col("usual_length")) / ((F.col("n_words") + 50) * F.col("usual_length"))).alias("x1"),
        F.sqrt((F.col("n_symbols") + 500 * F.col("usual_symbols")) / (F.col("word_chars") + 500)).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)).alias("x3"),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50)).alias("x4"),
    )
    vectors = staged(vectors, "mcd-vectors")
    fitting = vectors.filter("not base_failed").select(*GROUP, *STATS)
    estimate = staged(concentrate(fitting, coverage, steps), "mcd-best")
    limit = chi2_quantile(quantile, len(STATS))
    far = vectors.join(small(estimate), GROUP, "left").withColumn("d2", F.when(~F.col("base_failed"), distance()))
    outlying = (F.col("fitted") >= least) & (F.col("d2") > limit)
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(outlying, F.lit(False))).alias("kept"), "d2", *STATS,
    )
