"""Exact top-k by inner product, filtered by multi-resolution segment statistics.

A vector is cut into segments; of each segment only its mean m and deviation s are kept. For vectors q and x,
|q - x|^2 >= sum of L ((m_q - m_x)^2 + (s_q - s_x)^2) over segments of length L: a lower bound of the distance, and
through 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2 an upper bound of the inner product. Coarse segments are tried first;
pairs that can still reach a query's k-th best score go on to finer ones, and the survivors are scored exactly.

Queries go out in waves of a bounded size, each held against all rows, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, tidy


def integers(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector as doubles holding integers; None for a null vector or one with a null or non-finite component."""
    values = column.values.cast(pa.float64())
    empty = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(flat * scale)
    bad = np.r_[0, np.cumsum(empty | ~np.isfinite(flat))]
    at, nulls = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    return [None if nulls[i] or bad[at[i + 1]] > bad[at[i]] else whole[at[i] : at[i + 1]] for i in range(len(column))]


def levels(x: np.ndarray, segments: tuple[int, ...]) -> list[np.ndarray]:
    """For each resolution, rows whose dot product is the upper bound: sqrt(L) times means and deviations."""
    out = []
    for s in segments:
        cuts = np.linspace(0, x.shape[1], min(s, max(1, x.shape[1])) + 1).astype(int)
        parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        stats = [f(p, axis=1) * p.shape[1] ** 0.5 for p in parts for f in (np.mean, np.std)]
        out.append(np.column_stack(stats) if stats else np.zeros((len(x), 0)))
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows as longs: by doubles where these are exact, else by longs, else by whole numbers of any size."""
    if not (q.size and x.size):
        return np.zeros((len(q), len(x)), np.int64)
    high = np.abs(q).max() * np.abs(x).max(1) * q.shape[1]
    if high.max() < 2**52:
        return (q @ x.T).astype(np.int64)
    out = np.zeros((len(q), len(x)), np.int64)
    out[:, high < 2**62] = q.astype(np.int64) @ x[high < 2**62].astype(np.int64).T if np.abs(q).max() < 2**62 else 0
    whole = np.frompyfunc(int, 1, 1)
    for j in np.flatnonzero((high >= 2**62) | (np.abs(q).max() >= 2**62)).tolist():
        scores = whole(q) @ whole(x[j])
        if max(map(abs, scores)) >= 2**63:
            raise OverflowError("a score doesn't fit a long")
        out[:, j] = scores.astype(np.int64)
    return out


class Best:
    """The k best (score, id) of each query so far; ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.floor = np.full(n, -np.inf)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.r_[self.rows[i][0], scores], np.r_[self.rows[i][1], ids]
        o = np.lexsort((d, -s))[: self.k]
        self.rows[i] = s[o], d[o]
        if len(o) == self.k:
            self.floor[i] = s[o[-1]]


def search(q: np.ndarray, q_levels, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best, at: np.ndarray, segments) -> None:
    """Holds a block of rows x against the queries q, which are rows `at` of best."""
    x_levels = levels(x, segments)
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :] if x.shape[1] else np.zeros((len(q), len(x)))
    slack = 1.0 + 1e-9 * norm
    bound = np.minimum(q_levels[0] @ x_levels[0].T, norm) + slack
    own = q_ids[:, None] == ids[None, :]
    bound[own] = -np.inf
    k = best.k
    for i in np.flatnonzero(~np.isfinite(best.floor[at])):  # a first floor: the most promising rows of this block
        n = int((~own[i]).sum())
        top = np.argpartition(-bound[i], min(k, n) - 1)[: min(k, n)] if n else np.zeros(0, int)
        if len(top) == k:
            best.floor[at[i]] = np.sort(exact(q[i : i + 1], x[top])[0])[0]
    alive = (bound >= best.floor[at][:, None]) & ~own  # a floor may still be -inf
    for ql, xl in zip(q_levels[1:], x_levels[1:], strict=True):
        if alive.mean() > 0.2:
            alive &= ql @ xl.T + slack >= best.floor[at][:, None]
        else:
            i, j = np.nonzero(alive)
            for c in range(0, len(i), 1 << 16):
                a, b = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                alive[a, b] = np.einsum("ij,ij->i", ql[a], xl[b]) + slack[a, b] >= best.floor[at[a]]
    if alive.mean() > 0.2 and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2**62:
        scores = exact(q, x)
        for i in range(len(q)):
            j = np.flatnonzero(alive[i])
            if len(j):
                best.add(at[i], scores[i, j], ids[j])
    else:
        for i in range(len(q)):
            j = np.flatnonzero(alive[i])
            if len(j):
                best.add(at[i], exact(q[i : i + 1], x[j])[0], ids[j])


def _scan(wave, k: int, scale: int, segments, rows: int, block: int):
    def run(batches):
        by_size = {}
        for size, (ids, q) in wave.value.items():
            by_size[size] = ids, q, levels(q, segments), Best(len(q), k)
        held: dict[int, tuple[list, list]] = {}

        def flush(size):
            ids, vectors = held.pop(size)
            q_ids, q, q_levels, best = by_size[size]
            x, ids = np.array(vectors).reshape(len(ids), size), np.array(ids, np.int64)
            for a in range(0, len(q), block):
                at = np.arange(a, min(len(q), a + block))
                search(q[at], [y[at] for y in q_levels], q_ids[at], x, ids, best, at, segments)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), integers(b.column(1), scale), strict=True):
                if i is None or v is None or len(v) not in by_size:
                    continue
                one = held.setdefault(len(v), ([], []))
                one[0].append(i)
                one[1].append(v)
                if len(one[0]) == rows:
                    flush(len(v))
        for size in list(held):
            flush(size)
        for q_ids, _, _, best in by_size.values():
            n = [len(s) for s, _ in best.rows]
            at = np.repeat(np.arange(len(n)), n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(np.concatenate([d for _, d in best.rows])), pa.array(np.concatenate([s for s, _ in best.rows]))], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, segments: tuple[int, ...] = (4, 16), wave_bytes: int = 16 << 20, rows: int = 2048, block: int = 256) -> DataFrame:
    """The k rows with the largest inner product with each query, exactly; ties go to the smaller id.

    queries: a condition on the rows of vectors that picks the queries; a row is never its own answer. Components count
    as floor(scale * x). Vectors that are null, hold null or non-finite components, or have no id take no part, on
    either side; vectors of different lengths don't meet. Scores are exact at any size; one that is computed and doesn't
    fit a long raises OverflowError. An empty table, or no query, gives an empty result; other columns are ignored. If rows
    repeat an id, each counts as a candidate, none as an answer to its own id, and the id is answered once, for its
    lexicographically smallest vector. Returns query_id, rank, vec_id, score; fewer than k where there are fewer rows.
    Each wave of queries takes at most wave_bytes on the driver and as a broadcast; with more than one, each wave's best
    rows are written before the next one starts.
    """
    spark = vectors.sparkSession
    good = "id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    pair = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    rows_, chosen = vectors.select(*pair).where(good), vectors.where(queries).select(*pair).where(good)
    chosen = cut(chosen.groupBy("id").agg(F.min("v").alias("v")), "queries")
    total = chosen.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    waves = max(1, -(-2 * int(total) // wave_bytes)) if total > wave_bytes // 2 else 1
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for w in range(waves):
        mine = chosen.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == w) if waves > 1 else chosen
        by_size: dict[int, tuple[list, list]] = {}
        table = mine.toArrow()
        for i, v in zip(table.column(0).to_pylist(), integers(table.column(1).combine_chunks(), scale), strict=True):
            one = by_size.setdefault(len(v), ([], []))
            one[0].append(i)
            one[1].append(v)
        wave = spark.sparkContext.broadcast({n: (np.array(i, np.int64), np.array(v).reshape(len(i), n)) for n, (i, v) in by_size.items()})
        found = rows_.mapInArrow(tidy(_scan(wave, k, scale, segments, rows, block)), "query_id long, vec_id long, score long")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if waves == 1:
            return best
        parts.append(cut(best, "wave")._scratch)
        wave.destroy()
    return spark.read.schema(best.schema).parquet(*parts)
