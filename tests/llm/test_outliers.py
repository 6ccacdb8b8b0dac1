import re
from collections import Counter

import numpy as np

from urlsieve.llm import outliers
from urlsieve.llm.queries import op5_mcd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    inside = {k for j in range(len(w) - 4) if runs[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_counts_of_the_query(spark, sample, small_dir):
    got = op5_mcd(spark, small_dir).collect()
    want = {i: counts(t) for i, t in sample}
    assert len(got) == len(sample)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = outliers.judge(odd_docs).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(
        ((i, *counts(t)) for i, t, _, _ in odd_rows), key=key)
    assert all(r.kept != r.base_failed for r in got)  # groups this small reject nothing
    assert outliers.judge(no_docs).collect() == []


def test_junk_is_rejected_and_clean_rows_stay(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 8))) for _ in range(3000)]
    clean = [(i, " ".join(rng.choice(words, rng.integers(20, 400)).tolist()), "en", "ab"[i % 2]) for i in range(600)]
    clean += [(700, clean[0][1] + " 10% & more", "en", "b")]
    junk = [(1000 + i, " | ".join(rng.choice(words, 60).tolist()) + " ### $$$ %%%", "en", "a") for i in range(60)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in outliers.judge(docs).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)


def plain_estimate(x, coverage, steps):
    """Centre, precision and log determinant of the least one, by plain loops over the rows of one group."""
    floor = np.diag(np.square(outliers.FLOOR))
    rank = lambda v, q: np.sort(v)[int(np.ceil(q * len(v))) - 1]

    def moments(near, scale):
        scatter = np.cov(near.T, bias=True) * scale + floor
        return near.mean(axis=0), np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]

    def nearest(centre, precision, q):
        d2 = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
        return x[d2 <= rank(d2, q)]

    middle = np.array([rank(v, 0.5) for v in x.T])
    wide = np.array([rank(np.abs(v - m), 0.5) for v, m in zip(x.T, middle, strict=True)])
    first = middle, np.linalg.inv(np.diag(np.square(1.4826 * wide)) + floor), np.inf
    starts = [first, moments(x, 1.0), moments(nearest(*first[:2], 0.5), outliers.consistency(0.5))]
    found = []
    for centre, precision, _ in starts:
        now = centre, precision, np.inf
        for _ in range(steps):
            new = moments(nearest(*now[:2], coverage), outliers.consistency(coverage))
            if not new[2] < now[2] - 1e-9:
                break
            now = new
        found.append(now)
    return min(found, key=lambda f: f[2])


def test_distances_and_verdicts_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 8))) for _ in range(2000)]
    docs, n = [], 0
    for lang, source, many in (("en", "a", 420), ("de", None, 260), (None, "b", 30)):
        for k in range(many):
            text = " ".join(rng.choice(words, rng.integers(12, 300)).tolist())
            if k % 9 == 0:
                text += " | ### $$" * int(rng.integers(1, 30)) + ("\n" + text if k % 2 else "")
            docs.append((n, text, lang, source))
            n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in outliers.judge(df, least=200).collect()}
    limit = outliers.chi2_quantile(0.999999, 5)
    for lang, many in (("en", 420), ("de", 260)):
        own = [got[i] for i, _, l, _ in docs if l == lang]
        x = np.array([[r[s] for s in outliers.STATS] for r in own if not r.base_failed])
        centre, precision, _ = plain_estimate(x, 0.75, 20)
        d2 = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
        fitted = [r for r in own if not r.base_failed]
        assert len(own) == many and np.allclose([r.d2 for r in fitted], d2, rtol=1e-6)
        assert [r.kept for r in fitted] == (d2 <= limit).tolist()
    # the third group and the rest are too few to judge
    assert all(got[i].kept != got[i].base_failed for i, _, l, _ in docs if l is None)


def test_chi_square():
    assert abs(outliers.chi2_cdf(11.0705, 5) - 0.95) < 1e-4 and abs(outliers.chi2_quantile(0.99, 7) - 18.4753) < 1e-3
