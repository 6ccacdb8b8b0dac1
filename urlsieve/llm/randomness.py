"""Operator 11: secrets in texts, by known forms and by a battery of randomness tests.

Known forms are assignments to telling names, access keys and long hex runs. The battery looks
at every other long run of letters, digits and ``+/_-``: its encoding is inferred (decimal, hex,
base 32, base 64), its characters become symbols, and three tests ask whether these could be
uniform draws: chi-squared against the alphabet, runs above and below its middle, and
correlation of neighbours. Each gives a deviate with the exact mean and variance of uniform
draws; the sum of their squares is the run's *departure*, about chi-squared with three degrees.

A random string departs little, and so does some text by chance, the more often the shorter it
is. What text does is therefore measured: of the words outside long runs, the characters of each
encoding's alphabet are cut into windows of every length class, and these windows' departures
are counted over the whole corpus. A run's p-value is the share of text windows, of its encoding
and length class, that depart no more than it. Within each length class Benjamini and
Hochberg's step-up bounds the share of false finds by ``rate``, over all runs of the corpus;
a find must also pass the battery itself at ``level``. Both passes read texts where they lie; only counts
by (encoding, class, departure cell) travel, whose number the parameters bound.

A null text is empty; a row with any id, null included, gives one row, repeated rows each.
Very long texts and runs are read whole. An empty table gives an empty result. Where a corpus has
too few windows of an encoding and class, nothing of them is found. Other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.store import parts, table
from urlsieve.llm.text import spans, utf8

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
# long enough runs only: the leftmost match of the open-ended forms starts where these do
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: encodings by growing alphabet, and the name of a find
ENCODINGS = ("decimal", "hexadecimal", "base32", "base64")
KINDS = tuple(f"random_{e}" for e in ENCODINGS)
SIZES = np.array([10, 16, 32, 64])
CLASSES = np.array([16, 24, 32, 48, 64, 96, 128])
CELL = 0.125
CELLS = 513
SPAN = "array<struct<kind string, start int, end int>>"


def _symbols(chars: str) -> np.ndarray:
    out = np.full(256, -1, np.int16)
    out[np.frombuffer(chars.encode(), np.uint8)] = np.arange(len(chars))
    return out


def _run(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


_DIGITS, _UPPER, _LOWER = _run("0", "9"), _run("A", "Z"), _run("a", "z")
_HEX = _symbols(_DIGITS + _run("a", "f"))
_HEX_UPPER = _symbols(_DIGITS + _run("A", "F"))
_BASE64 = _symbols(_UPPER + _LOWER + _DIGITS + "+/")
_BASE64[[ord("-"), ord("_")]] = _BASE64[[ord("+"), ord("/")]]
_BASE32 = _symbols(_UPPER + _run("2", "7"))
#: of the text's windows: capitals alone are rare in text, so it counts in capitals for base 32
TABLES = (_symbols(_DIGITS), _HEX, np.maximum(_BASE32, _symbols(_LOWER)), _BASE64)
OUTSIDE = _BASE64 < 0
PLAIN = _symbols(_UPPER + _LOWER + _DIGITS) < 0


def departures(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Sum of the three squared deviates of each piece ``symbols[start:end]`` over ``size`` symbols."""
    n = ends - starts
    if not len(n):
        return np.empty(0)
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(starts - first, n)
    own = np.repeat(np.arange(len(n)), n)
    x = symbols[at].astype(np.int64)
    counts = np.bincount(own * size + x, minlength=len(n) * size).reshape(len(n), size)
    uniform = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    uniform = (uniform - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    inner = np.ones(len(x), bool)
    inner[first] = False  # the first symbol of a piece has no neighbour before it
    inner = np.flatnonzero(inner)
    high = x >= size // 2
    turns = np.bincount(own[inner], high[inner] != high[inner - 1], len(n))
    runs = (turns - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    centred = x - (size - 1) / 2
    serial = np.bincount(own[inner], centred[inner] * centred[inner - 1], len(n))
    serial = serial / ((size * size - 1) / 12 * np.sqrt(n - 1))
    return uniform**2 + runs**2 + serial**2


def passes(departure: float) -> float:
    """Chance that uniform draws depart at least so far (chi-squared, three degrees of freedom)."""
    return math.erfc(math.sqrt(departure / 2)) + math.sqrt(2 * departure / math.pi) * math.exp(-departure / 2)


def cell_of(departure: np.ndarray) -> np.ndarray:
    return np.minimum(departure / CELL, CELLS - 1).astype(np.int64)


def class_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, n, "right") - 1


def long_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, encoding, departure)`` of all runs of 16 or more symbols.

    A run with ``+/_-`` in it is base 64; its parts without these are runs of their own.
    """
    out = []
    starts, ends, _ = spans(data, offs, OUTSIDE)
    fit = ends - starts >= CLASSES[0]
    starts, ends = starts[fit], ends[fit]
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(PLAIN[data], out=signs[1:])
    mixed = signs[ends] > signs[starts]
    whole = starts[mixed], ends[mixed]
    out.append((*whole, np.full(len(whole[0]), 3), departures(_BASE64[data], *whole, 64)))
    starts, ends, _ = spans(data, offs, PLAIN)
    fit = ends - starts >= CLASSES[0]
    starts, ends = starts[fit], ends[fit]
    encoding = np.full(len(starts), 3)
    found = [(2, _BASE32), (1, _HEX_UPPER), (1, _HEX), (0, TABLES[0])]  # the smallest alphabet that holds all wins
    chosen = np.full(len(starts), -1)
    for k, (e, codes) in enumerate(found):
        missing = np.zeros(len(data) + 1, np.int64)
        np.cumsum(codes[data] < 0, out=missing[1:])
        holds = missing[ends] == missing[starts]
        encoding[holds], chosen[holds] = e, k
    for k in range(-1, len(found)):
        own = chosen == k
        if own.any():
            e, codes = (3, _BASE64) if k < 0 else found[k]
            out.append((starts[own], ends[own], encoding[own], departures(codes[data], starts[own], ends[own], int(SIZES[e]))))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(4))


def _cuts(longest: int) -> list[np.ndarray]:
    """Ends of windows whose lengths go round the classes, starting with each of them."""
    rounds = longest // int(CLASSES.sum()) + 2
    return [np.concatenate([[0], np.cumsum(np.tile(np.roll(CLASSES, -k), rounds))]) for k in range(len(CLASSES))]


def text_windows(data: np.ndarray, offs: np.ndarray, encoding: int) -> tuple[np.ndarray, np.ndarray]:
    """``(class, departure)`` of the text's windows over an encoding's alphabet, long runs left out."""
    starts, ends, _ = spans(data, offs, OUTSIDE)
    fit = ends - starts >= CLASSES[0]
    shut = np.zeros(len(data) + 1, np.int64)
    np.add.at(shut, starts[fit], 1)
    np.add.at(shut, ends[fit], -1)
    codes = TABLES[encoding][data]
    at = np.flatnonzero((codes >= 0) & (np.cumsum(shut[:-1]) == 0))
    symbols = codes[at]
    first = np.searchsorted(at, offs)
    sizes = np.diff(first)
    cuts = _cuts(int(sizes.max(initial=0)))
    a, b, c = [], [], []
    for start, n in zip(first[:-1].tolist(), sizes.tolist(), strict=True):
        if n >= CLASSES[0]:
            turn = n % len(CLASSES)
            own = cuts[turn][: np.searchsorted(cuts[turn], n, "right")]
            a.append(start + own[:-1])
            b.append(start + own[1:])
            c.append((turn + np.arange(len(own) - 1)) % len(CLASSES))
    if not a:
        return np.empty(0, np.int64), np.empty(0)
    return np.concatenate(c), departures(symbols, np.concatenate(a), np.concatenate(b), int(SIZES[encoding]))


def departure_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(cell, n)``: windows of the text and runs to be judged by (which, encoding, class, departure)."""
    shape = (2, len(ENCODINGS), len(CLASSES), CELLS)

    def run(source):
        total = np.zeros(shape, np.int64)
        for batch in parts(source, text):
            data, offs = utf8(batch.column(text))
            for e in range(len(ENCODINGS)):
                kind, departure = text_windows(data, offs, e)
                np.add.at(total, (0, e, kind, cell_of(departure)), 1)
            start, end, encoding, departure = long_runs(data, offs)
            np.add.at(total, (1, encoding, class_of(end - start), cell_of(departure)), 1)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield table(["cell", "n"], [pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())])

    return docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def accepted_cells(counts: np.ndarray, rate: float, level: float) -> np.ndarray:
    """For each (encoding, class) the number of departure cells whose runs are finds.

    Step-up within a length class: the largest p-value that is at most ``rate`` times the
    share of the class's runs with a p-value no larger.
    """
    windows, runs = counts[0], counts[1]
    p = (1 + np.cumsum(windows, axis=2)) / (1 + windows.sum(axis=2, keepdims=True))
    out = np.zeros(p.shape[:2], np.int64)
    passing = sum(passes(c * CELL) >= level for c in range(CELLS))
    for k in range(p.shape[1]):
        judged = runs[:, k].sum()
        if not judged:
            continue
        order = np.argsort(p[:, k].ravel(), kind="stable")
        values, below = p[:, k].ravel()[order], np.cumsum(runs[:, k].ravel()[order])
        last = np.searchsorted(values, values, "right") - 1  # cells of one p-value count together
        fit = values <= rate * below[last] / judged
        if fit.any():
            limit = values[fit].max()
            out[:, k] = np.minimum((p[:, k] <= limit).sum(axis=1), passing)
    return out


def calibrate(docs: DataFrame, rate: float = 0.01, level: float = 0.001, text: str = "text") -> np.ndarray:
    """Count the corpus and judge: ``accepted_cells`` of it. A few ten thousand counts reach the driver at most."""
    counts = np.zeros((2, len(ENCODINGS), len(CLASSES), CELLS), np.int64)
    found = departure_counts(docs, text).toPandas()
    counts.ravel()[found["cell"].to_numpy()] = found["n"].to_numpy()
    return accepted_cells(counts, rate, level)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` in code points of the known forms."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def find_secrets(docs: DataFrame, accepted: np.ndarray | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)`` of every row: the known forms and the battery's finds.

    Spans are in code points, the end exclusive, by start and then kind (``BASE`` before
    ``KINDS``). ``accepted`` is what ``calibrate`` found, by default on ``docs`` itself.
    """
    accepted = calibrate(docs, text=text) if accepted is None else accepted
    place = {k: i for i, k in enumerate(BASE + KINDS)}

    def run(source):
        for batch in parts(source, text):
            data, offs = utf8(batch.column(text))
            start, end, encoding, departure = long_runs(data, offs)
            fit = cell_of(departure) < accepted[encoding, class_of(end - start)]
            start, end, encoding = start[fit], end[fit], encoding[fit]
            more: dict[int, list] = {}
            for s, e, kind, own in zip(start.tolist(), end.tolist(), encoding.tolist(), (np.searchsorted(offs, start, "right") - 1).tolist(), strict=True):
                before = len(bytes(data[offs[own] : s]).decode())  # code points; the run itself is ASCII
                more.setdefault(own, []).append((before, KINDS[kind], before + e - s))
            out = []
            for i, body in enumerate(batch.column(text).to_pylist()):
                found = base_spans(body or "") + more.get(i, [])
                found.sort(key=lambda f: (f[0], place[f[1]], f[2]))
                out.append([{"kind": kind, "start": s, "end": e} for s, kind, e in found])
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield table([id_col, "spans"], [batch.column(id_col), pa.array(out, kinds)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, spans {SPAN}")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
