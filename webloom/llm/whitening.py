"""Whitening of embeddings: one-sided Jacobi on the R of a blockwise QR of the centred vectors.

Entries become integers x = floor(256 c), so that counts, sums and deviations are exact. The fit list holds every distinct vector
once. Each task centres its rows ((n x - S) / n, rounded once) and folds them, block by block, into a triangular R; the Rs are
stacked and factored again in groups of ``FAN`` until one is left (TSQR). Covariances are never formed: R'R is n V, and plane rotations
make R's columns orthogonal, whose lengths over sqrt(n) are the standard deviations and whose accumulated rotations are the components.
Small standard deviations keep their accuracy, as nothing is squared before the end.

What reaches the driver is bounded by the dimension d: d sums, one d x d matrix, and k x k products. Sums, deviations and the fit list are
shuffled by value, after partial aggregation, so a vector that makes up a third of all rows is one row for the fit from every task.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped; so are vectors whose length isn't the commonest one
(of equally common lengths the longest counts). Repeated rows give a row each and count once in the fit. Components without variance (eigenvalue 0 to
rounding, as with fewer distinct vectors than components) can't be whitened and are left out, so a table of one distinct vector, or an empty one, gives no
rows. Null ids stay. Equal eigenvalues share their plane: any basis of it is right, and one is taken for all rows. A deviation that
exceeds a long is null. Entries are exact up to 2**46 in size. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import core, released, written
from webloom.sources.shared import importable

SCALE = 256
#: Rs factored together in one task, and entries of a block of rows that is folded into R at once.
FAN, BLOCK_CELLS = 8, 1 << 19
#: Cosine between two columns of R under which they count as orthogonal; sweeps are few, the bound only stops a broken input.
EPS, SWEEPS = 1e-15, 60


@dataclass(frozen=True)
class Model:
    """n distinct vectors, their exact sums, components (columns, by falling eigenvalue), eigenvalues of x's covariance and its trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components whose variance isn't rounding: those the whitening can scale."""
        if not len(self.eigenvalues) or self.eigenvalues[0] <= 0:
            return 0
        return int((np.sqrt(self.eigenvalues) > np.sqrt(self.eigenvalues[0]) * len(self.sums) * 1e-15).sum())


def integral(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole: no null, no non-finite entry, at least one entry."""
    e = core(embeddings, "vec_id", "embedding").filter("embedding IS NOT NULL AND size(embedding) > 0")
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return e.filter(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vectors have the commonest length, and that length (0 if there are no rows)."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = top["d"] if top else 0
    return rows.filter(F.size("x") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_CELLS // d)
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        for i in range(0, len(x), step):
            yield x[i : i + step]


def exact_sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the sum of each dimension, exact. Tasks send d rows each; d rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * d
        for x in _blocks(batches, d):
            n += len(x)
            s = [a + b for a, b in zip(s, x.sum(axis=0).tolist())]
        if n:
            yield pa.RecordBatch.from_pydict({"pos": list(range(d)), "n": [n] * d, "s": [str(v) for v in s]}, schema=pa.schema([("pos", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    parts = fit.select("x").mapInArrow(run, "pos int, n long, s string")
    rows = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    return (rows[0]["n"], tuple(int(r["s"]) for r in rows)) if rows else (0, (0,) * d)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """(n x - S) / n, rounded once where the numerator is a long and by exact integers beyond."""
    big = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if big < 1 << 53:
        return (x * n - np.array(sums, np.int64)).astype(np.float64) / n
    return np.array([[(v * n - s) / n for v, s in zip(row, sums)] for row in x.tolist()], np.float64).reshape(x.shape)


def folded(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The R of r's rows on top of ``rows``: d x d, padded with zero rows."""
    d = rows.shape[1]
    out = np.linalg.qr(np.vstack([r, rows]), mode="r")
    return out if len(out) == d else np.vstack([out, np.zeros((d - len(out), d))])


_R = "block long, r array<double>"
_R_ARROW = pa.schema([("block", pa.int64()), ("r", pa.list_(pa.float64()))])


def _r_batch(block: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": [block], "r": [r.ravel().tolist()]}, schema=_R_ARROW)


def tsqr(fit: DataFrame, d: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the centred fit list: one R a task, then groups of FAN until one is left."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((d, d)), False
        for x in _blocks(batches, d):
            r, seen = folded(r, centred(x, n, sums)), True
        if seen:
            yield _r_batch(TaskContext.get().partitionId(), r)

    def merge(table: pa.Table) -> pa.Table:
        t = table.sort_by("block")
        r = np.zeros((d, d))
        for part in t.column("r"):
            r = folded(r, part.values.to_numpy().reshape(d, d))
        return pa.Table.from_batches([_r_batch(t.column("block")[0].as_py() // FAN, r)])

    level = written(fit.select("x").mapInArrow(leaf, _R), "op11-r")
    blocks = level.agg(F.max("block")).first()[0]
    while blocks > 0:
        above = written(level.withColumn("parent", F.expr(f"block div {FAN}")).groupBy("parent").applyInArrow(merge, _R), "op11-r")
        released(level)
        level, blocks = above, blocks // FAN
    (row,) = level.collect()
    released(level)
    return np.array(row["r"]).reshape(d, d)


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tournament: every pair of columns once, in rounds of disjoint pairs."""
    players = list(range(d + d % 2))
    out = []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(players[:half], reversed(players[half:])) if max(a, b) < d]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of r, by one-sided plane rotations.

    Every rotation makes two columns orthogonal; the pairs of a round are disjoint and turn together.
    """
    u, v = r.T.copy(), np.eye(r.shape[1])  # rows are the columns of r and of the accumulated rotations
    rounds = _rounds(r.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            a, b, g = (u[p] ** 2).sum(1), (u[q] ** 2).sum(1), (u[p] * u[q]).sum(1)
            on = np.abs(g) > EPS * np.sqrt(a * b)
            if not on.any():
                continue
            turned = True
            p, q, a, b, g = p[on], q[on], a[on], b[on], g[on]
            zeta = (b - a) / (2 * g)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (u, v):
                mp, mq = m[p], m[q]
                m[p], m[q] = c[:, None] * mp - s[:, None] * mq, s[:, None] * mp + c[:, None] * mq
        if not turned:
            break
    lengths = np.sqrt((u**2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    v = v[order] / np.sqrt((v[order] ** 2).sum(1))[:, None]
    signs = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    return lengths[order], (v * signs[:, None]).T


def fit_list(rows: DataFrame) -> DataFrame:
    """Every distinct vector once, written."""
    return written(rows.select("x").distinct(), "op11-fit")


def fit(distinct: DataFrame, d: int) -> Model:
    """The model of a fit list."""
    importable(distinct.sparkSession)
    n, sums = exact_sums(distinct, d) if d else (0, ())
    if not n:
        return Model(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    lengths, components = jacobi(tsqr(distinct, d, n, sums))
    eigenvalues = lengths**2 / n
    return Model(n, sums, components, eigenvalues, float(eigenvalues.sum()))


def projected(x: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Whitened coordinates; each row is summed by itself, so that equal vectors give equal values in any batch."""
    c = centred(x, model.n, model.sums)
    scaled = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])
    return np.stack([(c * scaled[:, j]).sum(axis=1) for j in range(k)], axis=1)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    big = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if big * big * len(sums) < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((v * n - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [e if e < 1 << 63 else None for e in exact]


def identity_error(distinct: DataFrame, model: Model, k: int) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity. Tasks send k x k products."""
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in _blocks(batches, d):
            y = projected(x, model, k)
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"cell": list(range(k * k)), "s": total.ravel().tolist()}, schema=pa.schema([("cell", pa.int32()), ("s", pa.float64())]))

    cells = distinct.select("x").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    covariance = np.zeros(k * k)
    for r in cells:
        covariance[r["cell"]] = r["s"] / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def transform(rows: DataFrame, model: Model, k: int) -> DataFrame:
    """Per row of (vec_id, x) and component up to k: the whitened coordinate, beside n, deviation and explained share."""
    d, k = len(model.sums), min(k, model.rank)
    if not k:
        return rows.sparkSession.createDataFrame([], _OUT)
    explained = (model.eigenvalues[:k] / model.trace).tolist()
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_CELLS // d)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x = _matrix(part.column("x"), d)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each), pa.array(projected(x, model, k).ravel()), pa.array(explained * m, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("vec_id", "x").mapInArrow(run, _OUT)


def whiten(embeddings: DataFrame, k: int = 4) -> DataFrame:
    """Per whole row of ``embeddings`` and component up to k: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, d = of_one_length(integral(embeddings))
    distinct = fit_list(rows)
    model = fit(distinct, d)
    error = identity_error(distinct, model, min(k, model.rank)) if model.rank else None
    released(distinct)
    return transform(rows, model, k).withColumn("identity_error", F.lit(error).cast("double"))


__all__ = ["Model", "fit", "fit_list", "integral", "jacobi", "transform", "whiten"]
