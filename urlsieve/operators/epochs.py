"""Models fitted by epochs: every task steps through its rows, then parameters are averaged.

The training rows are packed once into blocks of a written table, about ``block_rows`` a task. An
epoch is one job: a task starts from the parameters of the epoch before, passes over its
block in an order of the epoch's own, and cuts the result into slices; tasks of slices add
these up, weighted by rows. The driver holds one set of parameters, whose size follows from the
model and not from the data, and sends it out again. A task that is run again gives the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.operators.evaluate import roc_auc
from urlsieve.session import materialize, reachable

PACKED = "n int, label binary, sizes binary, indices binary, x binary"
_PACKED = pa.schema([("n", pa.int32()), ("label", pa.binary()), ("sizes", pa.binary()), ("indices", pa.binary()), ("x", pa.binary())])


@dataclass
class Rows:
    """A block of rows ``(label, indices, values)``, one after the other."""

    label: np.ndarray
    start: np.ndarray
    indices: np.ndarray
    x: np.ndarray

    def dense(self, size: int) -> np.ndarray:
        out = np.zeros((len(self.label), size))
        out[np.repeat(np.arange(len(self.label)), np.diff(self.start)), self.indices] = self.x
        return out

    @staticmethod
    def of(indices: pa.Array, values: pa.Array, label: np.ndarray | None = None) -> Rows:
        sizes = np.diff(np.asarray(indices.offsets))
        flat = indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
        return Rows(np.zeros(len(sizes)) if label is None else label, np.concatenate([[0], np.cumsum(sizes)]), *flat)

    @staticmethod
    def read(record: dict) -> Rows:
        start = np.concatenate([[0], np.cumsum(np.frombuffer(record["sizes"], np.int32))])
        return Rows(np.frombuffer(record["label"], np.float64), start, np.frombuffer(record["indices"], np.int32), np.frombuffer(record["x"], np.float64))


def pack_rows(df: DataFrame, block_rows: int) -> DataFrame:
    """``(label, key, indices, values)`` as one block per task, written; the key deals and orders the rows."""

    def run(source):
        held = [b for b in source if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        own = Rows.of(rows["indices"].combine_chunks(), rows["values"].combine_chunks(), rows["label"].to_numpy())
        yield pa.RecordBatch.from_pylist([{
            "n": len(own.label), "label": own.label.astype(np.float64).tobytes(), "sizes": np.diff(own.start).astype(np.int32).tobytes(),
            "indices": own.indices.astype(np.int32).tobytes(), "x": own.x.astype(np.float64).tobytes(),
        }], _PACKED)

    reachable(df.sparkSession)
    parts = max(1, -(-df.count() // block_rows))
    dealt = df.select("label", "key", "indices", "values").repartition(parts, "key").sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(run, PACKED), "packed")


#: (parameters, rows, epoch, seed of the block) -> parameters after the pass, loss summed over the rows
Pass = Callable[[np.ndarray, Rows, int, int], tuple[np.ndarray, float]]

SLICE = "slice int, n double, loss double, part binary"
_SLICE = pa.schema([("slice", pa.int32()), ("n", pa.float64()), ("loss", pa.float64()), ("part", pa.binary())])


def averaged_pass(blocks: DataFrame, parameters: np.ndarray, step: Pass, epoch: int, slices: int) -> tuple[np.ndarray, float]:
    """One epoch over all blocks: the mean of the tasks' parameters by rows, and the mean loss."""
    edges = np.linspace(0, len(parameters), slices + 1).astype(int)

    def run(source):
        for batch in source:
            for record in batch.to_pylist():
                rows = Rows.read(record)
                after, loss = step(parameters.copy(), rows, epoch, int(rows.label.sum()) * 1_000_003 + record["n"])
                yield pa.RecordBatch.from_pylist([
                    {"slice": k, "n": float(record["n"]), "loss": loss, "part": (after[a:b] * record["n"]).tobytes()}
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                ], _SLICE)

    def add(source):
        held: dict[int, list] = {}
        for batch in source:
            for r in batch.to_pylist():
                part = np.frombuffer(r["part"], np.float64)
                n, loss, total = held.get(r["slice"], (0.0, 0.0, 0.0))
                held[r["slice"]] = n + r["n"], loss + r["loss"], total + part
        rows = [{"slice": k, "n": n, "loss": loss, "part": total.tobytes()} for k, (n, loss, total) in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SLICE)

    sent = blocks.mapInArrow(run, SLICE).repartitionById(slices, F.col("slice"))
    found = sorted(sent.mapInArrow(add, SLICE).toArrow().to_pylist(), key=lambda r: r["slice"])
    if not found:
        return parameters, 0.0
    mean = np.concatenate([np.frombuffer(r["part"], np.float64) / r["n"] for r in found])
    return mean, found[0]["loss"] / found[0]["n"]


# --- linear: log loss, one row after the other


@dataclass(frozen=True)
class LinearConfig:
    """``l2`` is the weight of the squared norm's half; a fit stops after ``patience`` epochs without a gain of ``tolerance``."""

    l2: float = 1e-5
    epochs: int = 30
    tolerance: float = 1e-4
    patience: int = 5
    seed: int = 42
    block_rows: int = 65_536


def linear_pass(cfg: LinearConfig) -> Pass:
    """Steps of the rate 1 / (l2 (t0 + t)), ``t`` the rows a task has seen; the last parameter is the intercept.

    Decay of all weights by one factor a step is kept as a scale beside them.
    """
    typical = (1 / cfg.l2**0.5) ** 0.5
    t0 = 1 / (typical * cfg.l2)

    def run(w: np.ndarray, rows: Rows, epoch: int, seed: int) -> tuple[np.ndarray, float]:
        n, scale, loss, intercept = len(rows.label), 1.0, 0.0, w[-1]
        t = epoch * n
        for i in np.random.default_rng([cfg.seed, epoch, seed]).permutation(n).tolist():
            own = slice(rows.start[i], rows.start[i + 1])
            at, x = rows.indices[own], rows.x[own]
            z = scale * float(w[at] @ x) + intercept
            y = rows.label[i]
            loss += np.logaddexp(0.0, z) - y * z
            rate = 1 / (cfg.l2 * (t0 + t))
            t += 1
            scale *= max(0.0, 1 - rate * cfg.l2)
            back = rate * (0.5 * (1 + np.tanh(z / 2)) - y)
            if scale < 1e-9:
                w[:-1] *= scale
                scale = 1.0
            w[at] -= back / scale * x
            intercept -= back
        w[:-1] *= scale
        w[-1] = intercept
        return w, float(loss)

    return run


@dataclass
class Linear:
    """Weights by column, and the loss of every epoch."""

    weights: np.ndarray
    intercept: float
    losses: list[float]

    def raw(self, indices: pa.Array, values: pa.Array) -> np.ndarray:
        rows = Rows.of(indices, values)
        row = np.repeat(np.arange(len(rows.label)), np.diff(rows.start))
        return np.bincount(row, self.weights[rows.indices] * rows.x, len(rows.label)) + self.intercept

    def probability(self, indices: Column, values: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def score(indices: pa.Array, values: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-model.raw(indices, values))))

        return score(indices, values)


def fit_linear(df: DataFrame, size: int, cfg: LinearConfig = LinearConfig()) -> Linear:
    """``df(label, key, indices, values)`` with ``size`` columns -> weights of the least log loss."""
    blocks = pack_rows(df, cfg.block_rows)
    slices = _slices(df)
    w, losses, best, idle = np.zeros(size + 1), [], np.inf, 0
    for epoch in range(cfg.epochs):
        w, loss = averaged_pass(blocks, w, linear_pass(cfg), epoch, slices)
        losses.append(loss)
        idle = idle + 1 if loss > best - cfg.tolerance else 0
        best = min(best, loss)
        if idle >= cfg.patience:
            break
    return Linear(w[:-1], float(w[-1]), losses)


def _slices(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)


# --- a network of residual blocks


@dataclass(frozen=True)
class NetworkConfig:
    """Widths, rates and epochs; the defaults are the published settings."""

    hidden: int = 256
    epochs: int = 12
    batch: int = 1024
    rate: float = 1e-3
    least_rate: float = 1e-5
    decay: float = 1e-4
    drop: float = 0.25
    seed: int = 42
    block_rows: int = 65_536


def _shapes(size: int, hidden: int) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of all parameters; ``mean`` and ``var`` of a layer are its running statistics."""
    layers = [("in", size, hidden), *((f"res{k}{s}", hidden, hidden) for k in (1, 2) for s in "ab"), ("mid", hidden, hidden // 2)]
    out = []
    for name, a, b in layers:
        out += [(f"{name}.w", (a, b)), (f"{name}.b", (b,)), (f"{name}.gain", (b,)), (f"{name}.shift", (b,)), (f"{name}.mean", (b,)), (f"{name}.var", (b,))]
    return [*out, ("out.w", (hidden // 2, 1)), ("out.b", (1,))]


class Network:
    """Input layer, two residual blocks, a narrower layer, one output; each layer is normalised by batch, then SiLU."""

    def __init__(self, size: int, cfg: NetworkConfig, flat: np.ndarray | None = None):
        self.cfg, self.shapes = cfg, _shapes(size, cfg.hidden)
        self.total = sum(int(np.prod(s)) for _, s in self.shapes)
        self.flat = self.start() if flat is None else flat
        self.p, at = {}, 0
        for name, shape in self.shapes:
            n = int(np.prod(shape))
            self.p[name] = self.flat[at : at + n].reshape(shape)
            at += n

    def start(self) -> np.ndarray:
        rng, out = np.random.default_rng(self.cfg.seed), []
        bound = 1.0
        for name, shape in self.shapes:
            if name.endswith(".w"):
                bound = shape[0] ** -0.5
            fixed = {"gain": 1.0, "var": 1.0, "shift": 0.0, "mean": 0.0}.get(name.split(".")[1])
            out.append(rng.uniform(-bound, bound, int(np.prod(shape))) if fixed is None else np.full(int(np.prod(shape)), fixed))
        return np.concatenate(out)

    def layer(self, name: str, x: np.ndarray, drop: float, rng, tape: list | None) -> np.ndarray:
        """Linear, normalised, SiLU, dropout; ``tape`` keeps what the way back needs, and means training."""
        p = self.p
        z = x @ p[f"{name}.w"] + p[f"{name}.b"]
        if tape is None:
            norm = (z - p[f"{name}.mean"]) / np.sqrt(p[f"{name}.var"] + 1e-5)
            a = norm * p[f"{name}.gain"] + p[f"{name}.shift"]
            return a / (1 + np.exp(-a))
        mean, var, n = z.mean(axis=0), z.var(axis=0), len(z)
        p[f"{name}.mean"][:] = 0.9 * p[f"{name}.mean"] + 0.1 * mean
        p[f"{name}.var"][:] = 0.9 * p[f"{name}.var"] + 0.1 * var * n / max(n - 1, 1)
        root = np.sqrt(var + 1e-5)
        norm = (z - mean) / root
        a = norm * p[f"{name}.gain"] + p[f"{name}.shift"]
        s = 1 / (1 + np.exp(-a))
        kept = (rng.random(a.shape) >= drop) / (1 - drop) if drop else 1.0
        tape.append((name, x, norm, root, a, s, kept))
        return a * s * kept

    def back(self, kept_for: tuple, d: np.ndarray, grad: dict) -> np.ndarray:
        name, x, norm, root, a, s, kept = kept_for
        d = d * kept * (s + a * s * (1 - s))
        grad[f"{name}.gain"], grad[f"{name}.shift"] = (d * norm).sum(axis=0), d.sum(axis=0)
        d = d * self.p[f"{name}.gain"]
        d = (d - d.mean(axis=0) - norm * (d * norm).mean(axis=0)) / root
        grad[f"{name}.w"], grad[f"{name}.b"] = x.T @ d, d.sum(axis=0)
        return d @ self.p[f"{name}.w"].T

    def forward(self, x: np.ndarray, rng=None, tape: list | None = None) -> np.ndarray:
        drop = self.cfg.drop
        x = self.layer("in", x, drop, rng, tape)
        for k in (1, 2):
            x = x + self.layer(f"res{k}b", self.layer(f"res{k}a", x, drop, rng, tape), 0.0, rng, tape)
        x = self.layer("mid", x, drop / 2, rng, tape)
        if tape is not None:
            tape.append(x)
        return (x @ self.p["out.w"] + self.p["out.b"])[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        """Gradient of the mean log loss as a flat vector, running statistics at 0, and the loss."""
        tape: list = []
        z = self.forward(x, rng, tape)
        d = (0.5 * (1 + np.tanh(z / 2)) - y)[:, None] / len(y)
        top = tape.pop()
        grad = {"out.w": top.T @ d, "out.b": d.sum(axis=0)}
        d = self.back(tape.pop(), d @ self.p["out.w"].T, grad)
        for _ in (2, 1):
            inner = self.back(tape.pop(), d, grad)
            d = d + self.back(tape.pop(), inner, grad)
        self.back(tape.pop(), d, grad)
        flat = np.concatenate([grad.get(name, np.zeros(shape)).ravel() for name, shape in self.shapes])
        return flat, float((np.logaddexp(0, z) - y * z).sum())


def network_pass(size: int, cfg: NetworkConfig) -> Pass:
    """Adam with decay of the weights; its two moments and its count travel behind the parameters."""

    def run(state: np.ndarray, rows: Rows, epoch: int, seed: int) -> tuple[np.ndarray, float]:
        rng = np.random.default_rng([cfg.seed, epoch, seed])
        x, n = rows.dense(size), len(rows.label)
        net = Network(size, cfg, state[: (len(state) - 1) // 3])
        first, second = state[net.total : 2 * net.total], state[2 * net.total : -1]
        learnt = np.concatenate([np.full(int(np.prod(s)), not name.endswith((".mean", ".var"))) for name, s in net.shapes])
        rate = cfg.least_rate + (cfg.rate - cfg.least_rate) * (1 + np.cos(np.pi * epoch / cfg.epochs)) / 2
        order, loss = rng.permutation(n), 0.0
        for a in range(0, n, cfg.batch):
            own = order[a : a + cfg.batch]
            if len(own) < 2:
                continue  # a batch of one has no spread to normalise by
            grad, part = net.gradient(x[own], rows.label[own], rng)
            loss += part
            state[-1] += 1
            first *= 0.9
            first += 0.1 * grad
            second *= 0.999
            second += 0.001 * grad * grad
            move = (first / (1 - 0.9 ** state[-1])) / (np.sqrt(second / (1 - 0.999 ** state[-1])) + 1e-8)
            net.flat -= learnt * rate * (move + cfg.decay * net.flat)
        return state, loss

    return run


@dataclass
class Fitted:
    """The parameters of the best epoch, and ``(loss, validation AUC)`` of every epoch."""

    size: int
    cfg: NetworkConfig
    flat: np.ndarray
    epochs: list[tuple[float, float | None]]

    def raw(self, indices: pa.Array, values: pa.Array) -> np.ndarray:
        return Network(self.size, self.cfg, self.flat).forward(Rows.of(indices, values).dense(self.size))

    def probability(self, indices: Column, values: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def score(indices: pa.Array, values: pa.Array) -> pa.Array:
            return pa.array(0.5 * (1 + np.tanh(model.raw(indices, values) / 2)))

        return score(indices, values)


def fit_network(df: DataFrame, size: int, cfg: NetworkConfig = NetworkConfig(), validation: DataFrame | None = None) -> Fitted:
    """``df(label, key, indices, values)`` with ``size`` columns -> the state of best validation AUC.

    The first of equal epochs counts; without validation rows of both labels the last one does.
    """
    blocks = pack_rows(df, cfg.block_rows)
    net = Network(size, cfg)
    state = np.concatenate([net.flat, np.zeros(2 * net.total + 1)])
    history: list[tuple[float, float | None]] = []
    best, kept = 0.0, None
    for epoch in range(cfg.epochs):
        state, loss = averaged_pass(blocks, state, network_pass(size, cfg), epoch, _slices(df))
        now = Fitted(size, cfg, state[: net.total].copy(), history)
        auc = None
        if validation is not None:
            row = roc_auc(validation.select("label", now.probability(F.col("indices"), F.col("values")).alias("p")), "label", "p").first()
            auc = row["roc_auc"] if row else None
        history.append((loss, auc))
        if auc and auc > best:
            best, kept = auc, now
    return kept or now
