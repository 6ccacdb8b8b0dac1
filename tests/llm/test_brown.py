import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from urlsieve import session
from urlsieve.llm import brown
from urlsieve.llm.queries import op1_brown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(text or "").translate(LOWER).encode().split(), b"\n"]


def base(rows, train):
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [
        (i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        for i, t in rows
    ]


def by_row(rows):
    return sorted(((str(a), b, c, d, round(e, 6)) for a, b, c, d, e in rows))


def test_query_against_plain_counts(spark, sample, small_dir):
    got = op1_brown(spark, small_dir).collect()
    train = [t for i, t in sample if zlib.crc32(str(i).encode()) % 5 != 1]
    assert by_row(tuple(r)[0:1] + tuple(r)[2:6] for r in got) == by_row(base(sample, train))
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in sample if zlib.crc32(str(i).encode()) % 5 == 1}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_rare_words_come_from_the_join(spark, odd_docs, odd_rows):
    model, counts = brown.train(odd_docs.select("text"), classes=8, words=20, endings=7, top=50)
    got = brown.score(odd_docs, model, counts).collect()
    rows = [(i, t) for i, t, _, _ in odd_rows]
    assert by_row(tuple(r)[:5] for r in got) == by_row(base(rows, [t for _, t in rows]))
    classes = {r.word: r["class"] for r in brown.word_classes(model, counts).collect()}
    assert set(classes) == {w.decode() for _, t in rows for w in tokens(t)[:-1]} and set(classes.values()) <= set(range(7))


def test_empty_tables(spark, odd_docs, no_docs):
    model, counts = brown.train(no_docs.select("text"), classes=4, words=5, endings=2)
    assert brown.score(no_docs, model, counts).collect() == []
    got = brown.score(odd_docs, model, counts).collect()
    assert len(got) == odd_docs.count() and all(abs(r.base_score) < 1e-9 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_probabilities_add_up(spark, odd_docs):
    model, _ = brown.train(odd_docs.select("text"), classes=8, words=20, endings=7)
    assert np.allclose((10**model.step).sum(axis=1), 1)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    sides = [list(range(0, 10)), list(range(10, 20))]
    pairs = np.zeros((21, 21))
    for _ in range(5000):
        a, b = rng.choice(sides[0]), rng.choice(sides[1])
        pairs[a, b] += 1
        pairs[b, rng.choice(sides[0])] += 1
    of = brown.exchange(pairs, 3, 10)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 2


def test_words_of_one_ending_part_by_their_neighbours(spark):
    words = {"a": [f"a{k}zzz" for k in range(20)], "b": [f"b{k}zzz" for k in range(20)]}
    rows = [(f"the {a} of {b} the {words['a'][0]} of {words['b'][0]} the",) for a in words["a"] for b in words["b"]]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    model, counts = brown.train(docs, classes=6, words=4, endings=1, top=10)
    found = {r.word: r["class"] for r in brown.word_classes(model, counts).collect()}
    a, b = ({found[w] for w in words[k]} for k in "ab")
    assert len(a) == len(b) == 1 and a != b


def test_score_follows_from_classes_and_counts(spark, odd_docs, odd_rows):
    model, counts = brown.train(odd_docs.select("text"), classes=8, words=20, endings=7, top=50)
    of = {r.word.encode(): (r["class"], r.c) for r in counts.collect()} | {b"\n": (7, len(odd_rows))}
    want = []
    for i, t, _, _ in odd_rows:
        line = [of[w] for w in tokens(t)]
        before = [7, *(k for k, _ in line[:-1])]
        want.append((str(i), round(sum(model.step[x, k] - model.size[k] + math.log10(c + 0.5) for x, (k, c) in zip(before, line, strict=True)), 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in brown.score(odd_docs, model, counts).collect()) == sorted(want)
    grid = np.zeros((8, 8))
    for _, t, _, _ in odd_rows:
        line = [7, *(of[w][0] for w in tokens(t))]
        for x, y in zip(line[:-1], line[1:], strict=True):
            grid[x, y] += 1
    share = (grid.sum(axis=0) + 1) / (grid.sum() + 8)
    assert np.allclose(10**model.step, (grid + 2 * share) / (grid.sum(axis=1, keepdims=True) + 2))


def test_training_leaves_only_its_model_on_disk(spark, odd_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    brown.train(odd_docs.select("text"), classes=8, words=20, endings=7, top=50)
    left = {p.parent.name.rsplit("-", 1)[0] for p in tmp_path.rglob("part-*.parquet")}
    assert left == {"brown-bigrams", "brown-steps", "brown-classes"}  # counts of classes, and the words with theirs


def test_one_pass_trains_and_scores_as_two_do(spark, odd_docs, monkeypatch):
    passes, plain, settings = [], brown.classed, dict(classes=8, words=20, endings=7, top=50)
    monkeypatch.setattr(brown, "classed", lambda *a: passes.append(a) or plain(*a))
    learns = F.length("text") % 2 == 0  # null for a null text
    got = brown.train_and_score(odd_docs, learns, **settings).collect()
    assert len(passes) == 1
    want = brown.score(odd_docs, *brown.train(odd_docs.filter(learns).select("text"), **settings)).collect()
    assert sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in got) == sorted(
        str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in want
    )
