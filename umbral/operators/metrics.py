"""Privacy, utility and fidelity metrics as aggregations, and differential privacy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.detect import ColumnReport
from .bands import running


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """One row: k, groups, singletons, p25, p50, p75 of group sizes; nulls are a value."""
    g = df.groupBy(*quasi).count()
    p = [F.percentile("count", F.lit(x)).alias(f"p{round(100 * x)}") for x in (0.25, 0.5, 0.75)]
    return g.agg(F.min("count").alias("k"), F.count("*").alias("n_groups"), F.count_if(F.col("count") == 1).alias("singletons"), *p)


def k_histogram(df: DataFrame, quasi: list[str], n: int = 10) -> DataFrame:
    """group_size and how many groups have it; the n smallest."""
    return df.groupBy(*quasi).count().groupBy(F.col("count").alias("group_size")).agg(F.count("*").alias("n_groups")).orderBy("group_size").limit(n)


def interpret_k(k: int) -> str:
    return "critical" if k <= 1 else "high" if k < 3 else "medium" if k < 5 else "low"


def l_diversity(df: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """One row: l (fewest distinct values in a group), homogeneous groups, groups."""
    g = df.groupBy(*quasi).agg(F.count_distinct(sensitive).alias("l"))
    return g.agg(F.min("l").alias("l"), F.count_if(F.col("l") <= 1).alias("homogeneous"), F.count("*").alias("n_groups"))


def t_closeness(df: DataFrame, quasi: list[str], sensitive: str, numeric: bool = False, target: float = 0.2) -> DataFrame:
    """One row: t_max, t_mean, violations. Groups' distance to all rows: total variation, or the first Wasserstein distance.

    Group counts are joined to the distinct values' totals; groups of one row are at distance 1."""
    df = df.where(F.col(sensitive).isNotNull()).select(*quasi, F.col(sensitive).alias("__v"))
    total = df.groupBy("__v").agg(F.count("*").alias("__n"))
    every = Window.partitionBy()
    total = total.withColumn("__p", F.col("__n") / F.sum("__n").over(every))
    groups = df.groupBy(*quasi).agg(F.count("*").alias("__m"))
    counts = df.groupBy(*quasi, "__v").agg(F.count("*").alias("__c"))
    if not numeric:
        # sum |p - q| / 2 = sum of the excess of a group's shares over those of all
        near = counts.join(groups, quasi).join(total, "__v")
        dist = near.groupBy(*quasi, "__m").agg(F.sum(F.greatest(F.col("__c") / F.col("__m") - F.col("__p"), F.lit(0.0))).alias("__t"))
    else:
        up = Window.orderBy("__v")
        line = total.withColumn("__h", F.sum("__p").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__dx", F.lead("__v").over(up) - F.col("__v")).select("__v", "__h", "__dx")
        grid = groups.crossJoin(line)  # groups times distinct values: the statistic's own size
        grid = grid.join(counts, [*quasi, "__v"], "left")
        f = F.sum(F.coalesce(F.col("__c"), F.lit(0)) / F.col("__m")).over(Window.partitionBy(*quasi).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        dist = grid.withColumn("__f", f).groupBy(*quasi, "__m").agg(F.sum(F.abs(F.col("__f") - F.col("__h")) * F.coalesce("__dx", F.lit(0.0))).alias("__t"))
    dist = dist.withColumn("__t", F.when(F.col("__m") < 2, F.lit(1.0)).otherwise(F.col("__t")))
    return dist.agg(F.max("__t").alias("t_max"), F.avg("__t").alias("t_mean"), F.count_if(F.col("__t") > target).alias("violations"))


def reidentification_risk(df: DataFrame, quasi: list[str], direct: list[str] = (), masked: list[str] = ()) -> DataFrame:
    """One row: uniqueness, inference, structural and their weighted score (.5, .3, .2)."""
    n = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(quasi)])
    whole = df.dropna(subset=list(quasi)).groupBy(*quasi).count()
    single = whole.agg((F.count_if(F.col("count") == 1) / F.greatest(F.count("*"), F.lit(1))).alias("single"))
    unpivoted = df.select(*[F.col(c).cast("string").alias(c) for c in quasi]).unpivot([], [F.col(c) for c in quasi], "c", "v").where("v is not null")
    freq = unpivoted.groupBy("c", "v").count().groupBy("c").agg((F.max("count") / F.sum("count")).alias("top")).agg(F.avg("top").alias("inference"))
    bare = [c for c in direct if c not in set(masked)]
    structural = len(bare) / max(1, len(direct))
    uniq = sum((F.col(f"u{i}") / F.greatest(F.col("n"), F.lit(1)) for i in range(len(quasi))), F.lit(0.0)) / max(1, len(quasi))
    out = n.crossJoin(single).crossJoin(freq)  # three single rows
    out = out.select((0.6 * F.col("single") + 0.4 * uniq).alias("uniqueness"), F.coalesce("inference", F.lit(0.2)).alias("inference"), F.lit(float(structural)).alias("structural"))
    return out.withColumn("risk_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("uniqueness") + 0.3 * F.col("inference") + 0.2 * F.col("structural"))))


def interpret_risk(score: float) -> str:
    return next(name for top, name in ((0.2, "very low"), (0.4, "low"), (0.6, "medium"), (0.8, "high"), (9, "critical")) if score < top)


def anpd_compliant(score: float, k: int | None, k_threshold: int = 5) -> bool:
    return score < 0.2 if k is None else k >= k_threshold and score < 0.4


def privacy_score(df: DataFrame, reports: dict[str, ColumnReport], quasi: list[str] | None = None) -> dict:
    """0 to 100 of exposure (30), k (25), risk (20), density (15) and nulls (10), with a grade."""
    bare = [r for r in reports.values() if r.mask_strategy == "passthrough"]
    exposed = sum(r.is_direct_identifier for r in bare) + sum(r.risk_level == "high" for r in bare)
    exposure = {0: 30, 1: 20, 2: 10}.get(exposed, max(0, 30 - 10 * exposed))
    if quasi is None:
        quasi = [c for c, r in reports.items() if c in df.columns and (r.pii_type in ("quasi_identifier", "categorico") or r.risk_level == "low")][:4]
    k, k_points, risk, risk_points = None, 15, None, 10
    if quasi:
        k = k_anonymity(df.dropna(subset=quasi), quasi).first()["k"]
        k_points = next(p for least, p in ((10, 25), (5, 18), (3, 10), (2, 5), (-1, 0)) if (k or 0) >= least)
        direct = [c for c, r in reports.items() if r.is_direct_identifier]
        risk = reidentification_risk(df, quasi, direct, [c for c, r in reports.items() if r.mask_strategy != "passthrough"]).first()["risk_score"]
        risk_points = round((1 - risk) * 20)
    density = round(15 * (1 - len(reports) / max(1, len(df.columns))))
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")) for c in df.columns]).first()
    shares = [x or 0.0 for x in row]
    nulls = round(10 * (1 - sum(shares) / max(1, len(shares))))
    total = exposure + k_points + risk_points + density + nulls
    grade = next(g for least, g in ((90, "A"), (75, "B"), (60, "C"), (40, "D"), (-1, "F")) if total >= least)
    return {"total": total, "grade": grade, "exposure": exposure, "k_anonymity": k_points, "risk": risk_points, "density": density, "nulls": nulls, "k": k, "risk_score": risk}


# -- utility and fidelity


def _bins(a: DataFrame, b: DataFrame, edges: list[float], floor: float) -> DataFrame:
    """Shares of both sides in the bins between edges, in one aggregation each."""
    inner = edges[1:-1]

    def counted(df: DataFrame, name: str) -> DataFrame:
        bucket = sum((F.when(F.col("v") >= e, 1).otherwise(0) for e in inner), F.lit(0)) if inner else F.lit(0)
        out = df.where("v is not null").groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
        return out.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    both = counted(a, "p").join(counted(b, "q"), "bin", "full")
    grid = a.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(both, "bin", "left")
    return grid.select("bin", *[F.when(F.coalesce(c, F.lit(0.0)) <= 0, F.lit(floor)).otherwise(F.col(c)).alias(c) for c in ("p", "q")])


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("double").alias("v"))


def _no_psi(a: DataFrame) -> DataFrame:
    return a.sparkSession.range(1).select(F.lit(None).cast("double").alias("psi"))


def psi_equal_width(a: DataFrame, b: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over equal bins of the common range; null if neither side has a value."""
    x, y = _values(a, column), _values(b, column)
    low, high = x.unionByName(y).agg(F.min("v"), F.max("v")).first()
    if low is None:
        return _no_psi(a)
    edges = [low + (high - low) * i / bins for i in range(bins + 1)]
    return _bins(x, y, edges, 1e-6).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def psi_quantile(a: DataFrame, b: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over quantile bins of the first side; null if that has no value."""
    x, y = _values(a, column), _values(b, column)
    found = x.agg(F.percentile("v", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0]
    if found is None:
        return _no_psi(a)
    edges = sorted(set(found))
    return _bins(x, y, edges, 1e-3).agg(F.abs(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))).alias("psi"))


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic: the largest difference of the cumulated shares over distinct values."""
    n = _values(a, column).where("v is not null").select("v", F.lit(1).alias("a"), F.lit(0).alias("b"))
    m = _values(b, column).where("v is not null").select("v", F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = n.unionByName(m).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    up, every = running(g, {"a": "up_a", "b": "up_b"}, "v"), g.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    gap = F.abs(F.col("up_a") / F.col("all_a") - F.col("up_b") / F.col("all_b"))
    return up.crossJoin(F.broadcast(every)).agg(F.max(gap).alias("ks"))  # every is a single row


def _shares(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    every = Window.partitionBy()
    one = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().select("v", (F.col("count") / F.sum("count").over(every)).alias(n))
    return one(a, "p").join(one(b, "q"), "v", "full").fillna(0.0, ["p", "q"])


def kl_clipped(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Kullback-Leibler divergence of shares with 1e-9 added and renormalised, at most 1."""
    every = Window.partitionBy()
    s = _shares(a, b, column).select((F.col("p") + 1e-9).alias("p"), (F.col("q") + 1e-9).alias("q"))
    s = s.select((F.col("p") / F.sum("p").over(every)).alias("p"), (F.col("q") / F.sum("q").over(every)).alias("q"))
    return s.agg(F.least(F.lit(1.0), F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl_clipped"))


def jsd(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon divergence in nats."""
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(0.0)
    return _shares(a, b, column).agg(F.sum((part("p") + part("q")) / 2).alias("jsd"))


def top_k_overlap(a: DataFrame, b: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Jaccard similarity of the k most frequent values."""
    one = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count().orderBy(F.desc("count"), "v").limit(k).select("v", F.lit(1).alias(n))
    return one(a, "p").join(one(b, "q"), "v", "full").agg((F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()) / F.count("*")).alias("overlap"))


def correlation_delta(a: DataFrame, b: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """a, b, delta of correlations, changed (0.05 or more)."""
    from .stats import corr

    x, y = corr(a, columns, method), corr(b, columns, method).withColumnRenamed("corr", "other")
    delta = F.abs(F.coalesce(F.nanvl("corr", F.lit(0.0)), F.lit(0.0)) - F.coalesce(F.nanvl("other", F.lit(0.0)), F.lit(0.0)))
    return x.join(y, ["a", "b"]).select("a", "b", delta.alias("delta"), (delta >= 0.05).alias("changed"))


def utility(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean_diff_pct, std_diff_pct, ks, psi of numeric columns."""
    out = None
    for c in columns:
        x, y = a.agg(F.avg(c).alias("m1"), F.stddev_samp(c).alias("s1")), b.agg(F.avg(c).alias("m2"), F.stddev_samp(c).alias("s2"))
        pct = lambda p, q: F.abs(F.col(p) - F.col(q)) / F.greatest(F.abs(F.col(p)), F.lit(1e-9)) * 100
        one = x.crossJoin(y).crossJoin(ks(a, b, c)).crossJoin(psi_equal_width(a, b, c))  # single rows
        one = one.select(F.lit(c).alias("column"), pct("m1", "m2").alias("mean_diff_pct"), pct("s1", "s2").alias("std_diff_pct"), "ks", "psi")
        out = one if out is None else out.unionByName(one)
    return out


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of rows in boxes of at most size rows, split at the middle of the widest side."""
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = x[at]
        o = np.argpartition(own[:, np.argmax(own.max(0) - own.min(0))], len(at) // 2)
        todo += [at[o[len(at) // 2 :]], at[o[: len(at) // 2]]]
    return out


def _boxes(x: np.ndarray, size: int = 128) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows by box, and the boxes' lower and upper corners."""
    own = [x[at] for at in _leaves(x, size)]
    return own, np.array([y.min(0) for y in own]).reshape(-1, x.shape[1]), np.array([y.max(0) for y in own]).reshape(-1, x.shape[1])


def _two_nearest(q: np.ndarray, boxes) -> np.ndarray:
    """Distances from each row of q to its two nearest rows in boxes, exactly; boxes that can't hold a nearer row are skipped."""
    own, low, high = boxes
    out = np.full((len(q), 2), np.inf)
    for at in _leaves(q, 128):
        x, best = q[at], out[at]
        gap = np.maximum(0.0, np.maximum(low - x.max(0), x.min(0) - high))
        gap = (gap * gap).sum(1) * (1 - 1e-12)
        for j in np.argsort(gap).tolist():
            if gap[j] > best[:, 1].max():
                break
            d = sum((x[:, c, None] - own[j][None, :, c]) ** 2 for c in range(q.shape[1]))
            best = np.partition(np.column_stack([best, d]), 1, axis=1)[:, :2]
        out[at] = np.sqrt(best)
    return out


def nearest_distances(real: DataFrame, synthetic: DataFrame, columns: list[str], n: int | None = None, key: str | None = None, wave_bytes: int = 16 << 20) -> DataFrame:
    """One row: dcr (mean distance to the closest real row) and nndr (its ratio to the second), min-max scaled by the real rows.

    Every synthetic row is held against every real row, exactly; rows with a null take no part. Real rows go out in waves
    of at most wave_bytes. With n, only n rows of each side count, in the order of a hash of key (default: of the columns).
    """
    row = real.agg(*[x for c in columns for x in (F.min(c).cast("double"), F.max(c).cast("double"))]).first()
    low, high = [row[2 * i] or 0.0 for i in range(len(columns))], [row[2 * i + 1] or 0.0 for i in range(len(columns))]
    names = [f"x{i}" for i in range(len(columns))]

    def points(df: DataFrame) -> DataFrame:
        df = df.dropna(subset=columns)
        if n is not None:
            df = df.orderBy(F.xxhash64(*([key] if key else columns)), *columns).limit(n)
        return df.select(*[((F.col(c).cast("double") - low[i]) / max(1e-12, high[i] - low[i])).alias(names[i]) for i, c in enumerate(columns)]).groupBy(*names).agg(F.count("*").alias("n"))

    def search(boxes, most: int = 1 << 17):
        def flush(held):
            t = pa.Table.from_batches(held)
            two = _two_nearest(np.column_stack([t.column(c).to_numpy() for c in names]), boxes.value)
            two.sort(axis=1)
            two = pa.array([[d for d in x if d < np.inf] for x in two.tolist()], pa.list_(pa.float64()))
            return t.append_column("two", two).to_batches()

        def run(batches):
            held, rows = [], 0
            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= most:
                    yield from flush(held)
                    held, rows = [], 0
            if rows:
                yield from flush(held)

        return run

    a, b = points(real), points(synthetic)
    waves = max(1, -(-a.count() * 16 * len(columns) // wave_bytes))
    found = None
    for w in range(waves):
        t = a.where(F.pmod(F.xxhash64(*names), F.lit(waves)) == w).toArrow()
        x = np.column_stack([t.column(c).to_numpy() for c in names])
        boxes = real.sparkSession.sparkContext.broadcast(_boxes(np.repeat(x, np.minimum(t.column("n").to_numpy(), 2), axis=0)))
        part = b.mapInArrow(search(boxes), ", ".join(f"{c} double" for c in names) + ", n long, two array<double>")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(*names, "n").agg(F.sort_array(F.flatten(F.collect_list("two"))).alias("two"))  # two distances a wave
    best = best.select("n", F.get("two", F.lit(0)).alias("d1"), F.get("two", F.lit(1)).alias("d2"))
    ratio = F.when(F.col("d2").isNotNull(), F.col("d1") / F.greatest("d2", F.lit(1e-12)))
    mean = lambda x: F.sum(x * F.col("n")) / F.nullif(F.sum(F.when(x.isNotNull(), F.col("n"))), F.lit(0))
    return best.agg(mean(F.col("d1")).alias("dcr"), mean(ratio).alias("nndr"))


def tstr(real: DataFrame, synthetic: DataFrame, target: str, features: list[str]) -> dict:
    """Train on synthetic, test on real: accuracy of boosted trees for a 0/1 target against training on real rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    ready = lambda df: VectorAssembler(inputCols=features, outputCol="__x").transform(df.dropna(subset=[*features, target]).withColumn("__y", F.col(target).cast("double")))
    fit = lambda df: GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=10, seed=7).fit(ready(df))
    score = MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy")
    test, train = real.where(F.pmod(F.xxhash64(*features), F.lit(4)) == 0), real.where(F.pmod(F.xxhash64(*features), F.lit(4)) != 0)
    a, b = score.evaluate(fit(train).transform(ready(test))), score.evaluate(fit(synthetic).transform(ready(test)))
    return {"trtr": a, "tstr": b, "ratio": b / a if a else 0.0}


# -- differential privacy


class Budget:
    def __init__(self, epsilon: float):
        self.epsilon, self.spent, self.log = epsilon, 0.0, []

    def spend(self, epsilon: float, what: str) -> None:
        if self.spent + epsilon > self.epsilon + 1e-12:
            raise RuntimeError("the privacy budget is used up")
        self.spent += epsilon
        self.log.append((what, epsilon))


def laplace(scale: float | Column, u: Column) -> Column:
    u = u - 0.5
    return -scale * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


class DifferentialPrivacy:
    """Noise for releases; every call takes its epsilon from the budget."""

    def __init__(self, epsilon: float = 1.0, delta: float = 1e-5, seed: int = 42, budget: Budget | None = None):
        if epsilon <= 0:
            raise ValueError("epsilon must be positive")
        self.epsilon, self.delta, self.seed, self.budget = epsilon, delta, seed, budget

    def _spend(self, what: str) -> None:
        if self.budget:
            self.budget.spend(self.epsilon, what)

    def _noisy(self, df: DataFrame, columns: list[str], clip: bool, sensitivity: float | None, noise) -> DataFrame:
        row = df.agg(F.count("*"), *[x for c in columns for x in (F.min(c).cast("double"), F.max(c).cast("double"))]).first()
        made = {}
        for i, c in enumerate(columns):
            low, high = row[1 + 2 * i], row[2 + 2 * i]
            if low is None:
                continue
            x = F.col(c) + noise(sensitivity if sensitivity is not None else (high - low) / max(1, row[0]), i)
            made[c] = F.when(F.col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)) if clip else x)
        return df.withColumns(made)

    def laplace_columns(self, df, columns, sensitivity=None, clip=True) -> DataFrame:
        self._spend("laplace")
        return self._noisy(df, columns, clip, sensitivity, lambda s, i: laplace(s / self.epsilon, F.rand(self.seed + i)))

    def gaussian_columns(self, df, columns, sensitivity=None, clip=True) -> DataFrame:
        self._spend("gaussian")
        return self._noisy(df, columns, clip, sensitivity, lambda s, i: F.randn(self.seed + i) * (s * math.sqrt(2 * math.log(1.25 / self.delta)) / self.epsilon))

    def randomized_response(self, df, column: str, categories: list) -> DataFrame:
        self._spend("randomized response")
        k = len(categories)
        p = math.exp(self.epsilon) / (math.exp(self.epsilon) + k - 1)
        all_ = F.array(*map(F.lit, categories))
        other = F.filter(all_, lambda x: x != F.col(column))
        drawn = F.element_at(other, (F.floor(F.rand(self.seed + 1) * F.greatest(F.size(other), F.lit(1))) + 1).cast("int"))
        return df.withColumn(column, F.when(F.col(column).isNull() | (F.rand(self.seed) < p) | (F.lit(k) < 2), F.col(column)).otherwise(drawn))

    def count(self, df, sensitivity: float = 1.0) -> DataFrame:
        self._spend("count")
        return df.agg(F.count("*").alias("n")).select(F.greatest(F.lit(0.0), F.col("n") + laplace(sensitivity / self.epsilon, F.rand(self.seed))).alias("n"))

    def mean(self, df, column: str, low: float, high: float) -> DataFrame:
        self._spend("mean")
        one = df.agg(F.avg(F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))).alias("m"), F.count(column).alias("n"))
        return one.select((F.col("m") + laplace(F.lit((high - low) / self.epsilon) / F.greatest(F.col("n"), F.lit(1)), F.rand(self.seed))).alias("mean"))

    def histogram(self, df, column: str) -> DataFrame:
        self._spend("histogram")
        return df.groupBy(column).count().select(column, F.greatest(F.lit(0.0), F.col("count") + laplace(1 / self.epsilon, F.rand(self.seed))).alias("n"))
