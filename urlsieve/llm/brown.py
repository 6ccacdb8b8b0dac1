"""Operator 1: Brown class-based n-grams.

P(text) is the product over tokens of P(class | class before) P(word | class). The
training fold gives, with every training text counted:

* all word counts (one row per word, a written table of any size);
* bigram counts of word *types*. The ``words`` most frequent words are types of their own,
  any other word belongs to one of ``endings`` types by its last bytes, so that each
  word has a type and the type matrix is bounded by the parameters, not by the corpus;
* classes: exchange clustering moves one type after the other to the class that raises the
  likelihood of the class bigrams most, until a sweep moves none or ``sweeps`` are done. The
  end of a text is a class of its own, and the context of the first word;
* a class for each other word that training has twice or more, however many there are: a table of its
  neighbours' classes is counted, and by it the word leaves its ending's class for the one that
  raises the likelihood most, all words at once against the same grid of class bigrams. Words seen
  once and unseen ones keep the class of their ending;
* class transitions (interpolated with the class frequencies) and class sizes, counted anew
  with the classes of all words.

Classes and counts of the ``top`` most frequent words are a bounded broadcast table; those of
all other words come from a join with the table of words, a byte a token being filled in.

A null text is empty and has one token, its end. A null id is in the fold of the empty
string. Repeated rows are scored alike and train as often as they stand. Without training
texts, or in an empty table, the base score is 0 for every token. Texts of any length are
scored whole. Only id and text are read, so that other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.store import drop_staged, parts, staged, table
from urlsieve.llm.text import LOWER, cut_words, distinct, owners, spans, utf8, word_hashes

TAIL = 3


@dataclass
class Brown:
    """The bounded part of the model; the counts of all words are a table of their own."""

    hashes: np.ndarray  # of the most frequent words, sorted
    rank: np.ndarray  # by falling count
    count: np.ndarray
    words: int
    endings: int
    classes: np.ndarray  # class of each type, the last type is the end
    step: np.ndarray  # log10 P(class | class before)
    size: np.ndarray  # log10 of a class's smoothed mass
    tokens: int
    distinct: int
    texts: int
    least: int = 0  # no word beyond the frequent ones counts more
    own: np.ndarray | None = None  # class of each of the most frequent words

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word in the table of frequent words, -1 beyond it."""
        if not len(self.hashes) or not len(hashes):
            return np.full(len(hashes), -1)
        values, code = distinct(hashes)
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        return np.where(self.hashes[at] == values, at, -1)[code]

    def types(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        tail = word_hashes(data, np.maximum(starts, ends - TAIL), ends, 5) % np.uint64(self.endings)
        own = self.rank[at] if len(self.rank) else np.zeros(len(at), np.int64)
        return np.where((at >= 0) & (own < self.words), own, self.words + tail.astype(np.int64))

    def classes_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Classes of the frequent words, and of all others by their ending."""
        by_type = self.classes[self.types(data, starts, ends, at)]
        return by_type if self.own is None or not len(self.own) else np.where(at >= 0, self.own[at], by_type)

    @property
    def end(self) -> int:
        return self.words + self.endings


def lowered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offs = utf8(batch.column("text"))
    data = LOWER[data]
    return data, *spans(data, offs)


def with_ends(values: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words with ``end`` behind each text, and where the texts begin."""
    return np.insert(values, first[1:], end), first[:-1] + np.arange(len(first) - 1)


def word_counts(rows: DataFrame) -> DataFrame:
    def run(source):
        for batch in parts(source, "text"):
            data, s, e, _ = lowered(batch)
            values, code = distinct(word_hashes(data, s, e))
            some = np.zeros(len(values), np.int64)
            some[code] = np.arange(len(code))
            yield table(["word", "c"], [cut_words(data, s[some], e[some]).cast(pa.string()), pa.array(np.bincount(code, minlength=len(values)).astype(np.int64))])

    return rows.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def type_bigrams(rows: DataFrame, model: Brown) -> np.ndarray:
    """Counts of adjacent types, ends included; types^2 cells at most reach the driver."""
    many = model.end + 1

    def run(source):
        cells = np.zeros(many * many, np.int64)
        for batch in parts(source, "text"):
            data, s, e, first = lowered(batch)
            types = model.types(data, s, e, model.places(word_hashes(data, s, e)))
            line, _ = with_ends(types, first, model.end)
            pair, n = np.unique(np.concatenate([[model.end], line[:-1]]) * many + line, return_counts=True)
            cells[pair] += n
        some = np.flatnonzero(cells)
        for a in range(0, len(some), 1 << 17):
            part = some[a : a + (1 << 17)]
            yield table(["pair", "n"], [pa.array(part.astype(np.int32)), pa.array(cells[part])])

    found = rows.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    got = staged(found, "brown-bigrams").toArrow()
    out = np.zeros(many * many, np.int64)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(many, many)


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each type; the last type keeps the last class for itself."""
    many, last = len(pairs), classes - 1
    pairs = pairs.astype(float)
    often = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1))[:-1], kind="stable")
    of = np.empty(many, np.int64)
    of[often] = np.arange(many - 1) % last
    of[-1] = last
    member = np.zeros((many, classes))
    member[np.arange(many), of] = 1
    grid = member.T @ pairs @ member
    columns = np.ascontiguousarray(pairs.T)
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for t in often.tolist():
            right, left, own = pairs[t], columns[t], pairs[t, t]
            total = right.sum() + left.sum()
            if not total:
                continue
            now = of[t]
            r = np.bincount(of, right, classes)
            l = np.bincount(of, left, classes)  # noqa: E741
            r[now] -= own
            l[now] -= own
            grid[now, :] -= r
            grid[:, now] -= l
            grid[now, now] -= own
            np.maximum(grid, 0, out=grid)
            base = phi(grid)
            across = grid + r
            across[diagonal, diagonal] += l + own
            down = grid + l[:, None]
            gain_down = phi(down) - base
            gain_down[diagonal, diagonal] = 0
            rows, cols = grid.sum(axis=1), grid.sum(axis=0)
            gain = (phi(across) - base).sum(axis=1) + gain_down.sum(axis=0)
            gain -= phi(rows + r.sum() + own) - phi(rows) + phi(cols + l.sum() + own) - phi(cols)
            gain[last] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[now] + 1e-9:
                best = int(now)
            moved += best != now
            of[t] = best
            grid[best, :] += r
            grid[:, best] += l
            grid[best, best] += own
        if not moved:
            break
    return of


def neighbours(rows: DataFrame, model: Brown, classes: int) -> DataFrame:
    """``(word, typed, around, n)`` of the words beyond the clustered types that training has twice or more.

    ``word`` is the word's hash, ``typed`` the class of its ending; ``around``: ``classes`` x the class
    before a word + the class behind it; ``n``: how often.
    """

    def run(source):
        for batch in parts(source, "text"):
            data, s, e, first = lowered(batch)
            hashes = word_hashes(data, s, e)
            types = model.types(data, s, e, model.places(hashes))
            line, _ = with_ends(model.classes[types], first, model.classes[-1])
            some = np.flatnonzero(types >= model.words)
            if not len(some):
                continue
            values, code = distinct(hashes[some])
            at = some + owners(first)[some]  # an end stands behind each text before it, and before the first text
            cells = classes * classes
            pair, n = np.unique(code.astype(np.int64) * cells + line[at - 1] * classes + line[at + 1], return_counts=True)
            typed = np.zeros(len(values), np.int64)
            typed[code] = line[at]
            word = pair // cells
            yield table(["word", "typed", "around", "n"], [
                pa.array(values[word].view(np.int64)), pa.array(typed[word].astype(np.int32)),
                pa.array((pair % cells).astype(np.int32)), pa.array(n.astype(np.int64)),
            ])

    found = rows.select("text").mapInArrow(run, "word long, typed int, around int, n long").groupBy("word", "typed", "around").agg(F.sum("n").alias("n"))
    met = found.groupBy("word", "typed").agg(F.sum("n").alias("c"), F.collect_list(F.struct("around", "n")).alias("met"))
    return met.filter("c > 1").select("word", "typed", F.col("met.around").alias("around"), F.col("met.n").alias("n"))


def word_exchange(met: DataFrame, grid: np.ndarray) -> DataFrame:
    """``(word, typed, class)``: each word's best class by its ``neighbours`` and the class bigrams ``grid``.

    A word's counts are taken out of its present class; all other words stay where they are.
    """
    classes = len(grid)
    cells = np.concatenate([grid.T, grid]).astype(float)
    totals = grid.sum(axis=1).astype(float), grid.sum(axis=0).astype(float)

    def run(source):
        for whole in source:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                now = batch.column("typed").to_numpy()
                around, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("around", "n"))
                row = np.repeat(np.arange(len(now)), pc.list_value_length(batch.column("around")).to_numpy())
                # the class behind a word, and ``classes`` + the class before it
                side = np.concatenate([around % classes, classes + around // classes]) + np.tile(row, 2) * 2 * classes
                side, code = np.unique(side, return_inverse=True)
                n = np.bincount(code, np.tile(n, 2))
                row, side = side // (2 * classes), side % (2 * classes)
                sizes = np.bincount(row, minlength=len(now))
                without = cells[side]
                place = np.arange(len(side)), now[row]
                without[place] = np.maximum(without[place] - n, 0)
                gain = np.add.reduceat(phi(without + n[:, None]) - phi(without), np.cumsum(sizes) - sizes)
                for total, behind in zip(totals, (True, False), strict=True):
                    own = np.bincount(row, np.where((side < classes) == behind, n, 0), len(sizes))[:, None]
                    left = np.tile(total, (len(sizes), 1))
                    left[np.arange(len(sizes)), now] = np.maximum(left[np.arange(len(sizes)), now] - own[:, 0], 0)
                    gain -= phi(left + own) - phi(left)
                gain[:, -1] = -np.inf
                best = gain.argmax(axis=1)
                at = np.arange(len(sizes))
                best = np.where(gain[at, best] > gain[at, now] + 1e-9, best, now)
                yield table(["word", "typed", "class"], [batch.column("word"), batch.column("typed"), pa.array(best.astype(np.int32))])

    return met.mapInArrow(run, "word long, typed int, class int")


def classed(rows: DataFrame, model: Brown, counts: DataFrame) -> DataFrame:
    """``rows(doc_id, learns, text)`` as ``(doc_id, learns, n_known, mass, own)``, a written table.

    ``own`` holds the class of each token, a byte a token; ``n_known`` are the tokens that training
    has, ``mass`` is the sum of the logarithms of their counts.
    """
    log_count = np.log10(model.count + 0.5) if len(model.count) else np.zeros(1)
    log_end = np.log10(model.texts + 0.5)

    def run(source):
        for batch in parts(source, "text"):
            data, s, e, first = lowered(batch)
            at = model.places(word_hashes(data, s, e))
            own, begin = with_ends(model.classes_of(data, s, e, at), first, len(model.step) - 1)
            mass = np.add.reduceat(with_ends(np.where(at >= 0, log_count[at], 0.0), first, log_end)[0], begin)
            n_known = np.add.reduceat(with_ends((at >= 0).astype(np.int64), first, int(model.texts > 0))[0], begin)
            rare = np.flatnonzero(at < 0)
            cuts = pa.array(np.searchsorted(rare, first).astype(np.int32))
            raw = own.astype(np.uint8).tobytes()
            lines = [raw[a:b] for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(raw)], strict=True)]
            yield table(["doc_id", "learns", "n_known", "mass", "own", "place", "rare"], [
                batch.column("doc_id"), batch.column("learns"), pa.array(n_known), pa.array(mass), pa.array(lines, pa.binary()),
                pa.ListArray.from_arrays(cuts, pa.array((rare - first[owners(first)[rare]]).astype(np.int32))),
                pa.ListArray.from_arrays(cuts, cut_words(data, s[rare], e[rare]).cast(pa.string())),
            ])

    part = rows.mapInArrow(run, "doc_id long, learns boolean, n_known long, mass double, own binary, place array<int>, rare array<string>")
    part = staged(part.withColumn("row", F.monotonically_increasing_id()), "brown-parts")
    # counts and classes of all words beyond the frequent ones
    rest = part.select("row", F.posexplode("rare").alias("at", "word"))
    few = counts.filter(F.col("c") <= model.least) if model.least else counts.limit(0)
    known = F.when(F.col("c").isNotNull(), F.struct("at", "class"))
    met = rest.join(few, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"), F.count("c").alias("seen"), F.collect_list(known).alias("met")
    )
    none = F.array().cast("array<int>")
    whole = part.drop("rare").join(met, "row", "left").select(
        "doc_id", "learns", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), (F.col("mass") + F.coalesce("rest", F.lit(0.0))).alias("mass"),
        "own", "place", F.coalesce("met.at", none).alias("at"), F.coalesce("met.class", none).alias("class"),
    )
    lines = staged(whole.mapInArrow(filled, LINES), "brown-lines")
    drop_staged(part)
    return lines


LINES = "doc_id long, learns boolean, n_known long, mass double, own binary"


def filled(source):
    """Token classes of rows whose tokens beyond the frequent words are numbered by ``place``: those numbered ``at`` get ``class``."""
    for batch in source:
        if batch.num_rows:
            own, begin, sizes = tokens(batch)
            many, held = (pc.list_value_length(batch.column(c)).to_numpy() for c in ("place", "at"))
            place, at, found = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("place", "at", "class"))
            row = np.repeat(np.arange(len(sizes)), held)
            own[begin[row] + place[(np.cumsum(many) - many)[row] + at]] = found
            raw = own.tobytes()
            lines = [raw[a : a + n] for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
            names = ["doc_id", "learns", "n_known", "mass"]
            yield table([*names, "own"], [*(batch.column(c) for c in names), pa.array(lines, pa.binary())])


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a batch, the first token of each row, and their numbers."""
    lines = batch.column("own").to_pylist()
    sizes = np.array([len(x) for x in lines], np.int64)
    return np.frombuffer(b"".join(lines), np.uint8).copy(), np.cumsum(sizes) - sizes, sizes


def class_bigrams(rows: DataFrame, classes: int) -> np.ndarray:
    """Counts of adjacent classes of ``classed`` rows, ends included."""

    def run(source):
        cells = np.zeros(classes * classes, np.int64)
        for batch in source:
            if batch.num_rows:
                own = tokens(batch)[0].astype(np.int64)
                cells += np.bincount(np.concatenate([[classes - 1], own[:-1]]) * classes + own, minlength=len(cells))
        some = np.flatnonzero(cells)
        yield table(["pair", "n"], [pa.array(some.astype(np.int32)), pa.array(cells[some])])

    found = rows.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    got = staged(found, "brown-steps").toArrow()
    out = np.zeros(classes * classes, np.int64)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes, classes)


def cluster(rows: DataFrame, classes: int, words: int, endings: int, top: int, sweeps: int) -> tuple[Brown, DataFrame]:
    """The classes of a model, without its transitions, and the words ``(word, c, class)``."""
    counts = words_alone = staged(word_counts(rows), "brown-words")
    texts = rows.count()
    total, many = counts.agg(F.sum("c"), F.count("*")).first()
    frequent = counts.orderBy(F.desc("c"), "word").limit(top).toArrow()
    column = frequent.column("word").combine_chunks()
    data, offs = utf8(column if isinstance(column, pa.Array) else pa.array([], pa.string()))
    hashes = word_hashes(data, offs[:-1], offs[1:])
    order = np.argsort(hashes)
    c = frequent.column("c").to_numpy()
    model = Brown(
        hashes[order], order, c[order], words, endings, np.zeros(words + endings + 1, np.int64), np.zeros((classes, classes)),
        np.zeros(classes), (total or 0) + texts, many + (texts > 0), texts, int(c[-1]) if len(c) == top else 0,
    )
    pairs = type_bigrams(rows, model)
    model.classes = exchange(pairs, classes, sweeps)
    member = np.zeros((len(pairs), classes))
    member[np.arange(len(pairs)), model.classes] = 1
    moved = word_exchange(neighbours(rows, model, classes), member.T @ pairs @ member)

    def by_type(source):
        for batch in source:
            data, offs = utf8(batch.column("word"))
            s, e = offs[:-1], offs[1:]
            hashes = word_hashes(data, s, e)
            own = model.classes[model.types(data, s, e, model.places(hashes))]
            yield table(["name", "c", "word", "typed"], [batch.column("word"), batch.column("c"), pa.array(hashes.view(np.int64)), pa.array(own.astype(np.int32))])

    typed = counts.mapInArrow(by_type, "name string, c long, word long, typed int").join(moved, ["word", "typed"], "left")
    counts = staged(typed.select(F.col("name").alias("word"), "c", F.coalesce("class", "typed").alias("class")), "brown-classes")
    drop_staged(words_alone)
    model.own = counts.orderBy(F.desc("c"), "word").limit(top).toArrow().column("class").to_numpy()[order].astype(np.int64)
    return model, counts


def weigh(model: Brown, counts: DataFrame, lines: DataFrame, pull: float) -> None:
    """Transitions and sizes of the classes, from the training rows of ``classed``."""
    classes = len(model.step)
    grid = class_bigrams(lines, classes).astype(float)
    mass = grid.sum(axis=0)
    share = (mass + 1) / (mass.sum() + classes)
    model.step = np.log10((grid + pull * share) / (grid.sum(axis=1, keepdims=True) + pull))
    members, held = np.zeros(classes), np.zeros(classes)
    for r in counts.groupBy("class").agg(F.count("*").alias("n"), F.sum("c").alias("m")).collect():
        members[r["class"]], held[r["class"]] = r.n, r.m
    members[classes - 1], held[classes - 1] = int(model.texts > 0), model.texts
    model.size = np.log10(held + 0.5 * (members + 1))


def train(
    rows: DataFrame, classes: int = 64, words: int = 1200, endings: int = 335, top: int = 1 << 16, sweeps: int = 6, pull: float = 2.0,
) -> tuple[Brown, DataFrame]:
    """Model and words ``(word, c, class)`` of the texts in ``rows(text)``; ``classes`` fit a byte."""
    model, counts = cluster(rows, classes, words, endings, top, sweeps)
    lines = classed(rows.select(F.lit(0).cast("long").alias("doc_id"), F.lit(True).alias("learns"), "text"), model, counts)
    weigh(model, counts, lines, pull)
    drop_staged(lines)
    return model, counts


def word_classes(model: Brown, counts: DataFrame) -> DataFrame:
    """``(word, c, class)`` of every training word."""
    return counts.select("word", "c", "class")


def score(docs: DataFrame, model: Brown, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(False).alias("learns"), F.col(text_col).alias("text"))
    return scored(classed(rows, model, counts), model)


def train_and_score(
    docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text",
    classes: int = 64, words: int = 1200, endings: int = 335, top: int = 1 << 16, sweeps: int = 6, pull: float = 2.0,
) -> DataFrame:
    """``score`` of all rows by ``train`` on those that ``learns`` names; the texts are classed once for both."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col(text_col).alias("text"))
    model, counts = cluster(rows.filter("learns").select("text"), classes, words, endings, top, sweeps)
    lines = classed(rows, model, counts)
    weigh(model, counts, lines.filter("learns"), pull)
    return scored(lines, model)


def scored(lines: DataFrame, model: Brown) -> DataFrame:
    """Scores of the rows of ``classed``."""

    def run(source):
        for batch in source:
            if batch.num_rows:
                own, begin, sizes = tokens(batch)
                before = np.concatenate([[len(model.step) - 1], own[:-1]])
                terms = np.add.reduceat(model.step[before, own] - model.size[own], begin)
                yield table(["doc_id", "n_tokens", "n_known", "terms", "mass"], [
                    batch.column("doc_id"), pa.array(sizes), batch.column("n_known"), pa.array(terms), batch.column("mass"),
                ])

    whole = lines.mapInArrow(run, "doc_id long, n_tokens long, n_known long, terms double, mass double")
    n = F.col("n_tokens")
    total = F.col("terms") + F.col("mass")
    return whole.select(
        "doc_id", "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("mass") - n * F.lit(float(np.log10(model.tokens + 0.5 * (model.distinct + 1))))).alias("base_score"),
        total.alias("score"), F.pow(F.lit(10.0), -total / n).alias("perplexity"),
    )
