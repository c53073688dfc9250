"""Masking of whole frames, joins on masked keys, mocks and synthetic rows."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as K
from ..functions.detect import ColumnReport, already_masked, frequencies, scan
from . import frame

KINDS = {"cpf": "digits", "cnpj": "digits", "email": "email"}
BY_RISK = {"high": "suppress", "medium": "hash", "low": "truncate"}


class IdempotencyError(ValueError):
    """A column holds tokens already."""


def expression(df: DataFrame, report: ColumnReport, salt: str, seed: int = 42, key: Column | None = None, strategy: str | None = None) -> Column:
    """The mask of one column."""
    name, kind = report.column, dict(df.dtypes)[report.column]
    c, how = F.col(f"`{name}`"), strategy or report.mask_strategy
    if how == "hash":
        return K.token(c, salt, KINDS.get(report.pii_type, "generic"))
    if how == "redact":
        return K.redact(c)
    if how == "truncate":
        return K.truncate_postcode(c)
    if how == "suppress":
        return K.suppress(c)
    if how == "mask_phone_ddd":
        return K.mask_phone(c)
    if how == "generalize_date":
        return K.decade(c, kind)
    u = K.uniform(key, seed + sum(name.encode()))
    if how == "mock_numeric":
        low, high = (0.0 if report.col_min is None else report.col_min), (1.0 if report.col_max is None else report.col_max)
        return K.mock_number(c, low, high, kind in ("tinyint", "smallint", "int", "bigint"), u)
    if how == "mock_category":
        return K.mock_category(c, report.value_freq, u)
    return c


def mask(df: DataFrame, *, salt: str | None = None, columns=None, exclude=None, risk: str | None = None, reports: dict | None = None, strict: bool = True, seed: int = 42, key: str | None = None, mode: str = "fast", strategies: dict[str, str] | None = None) -> DataFrame:
    """Every column that holds personal data, masked by its strategy; one lazy projection.

    risk masks the columns of that level alone, by the level's strategy. strict raises where a column holds tokens.
    key names a row key that makes mocks the same on every run."""
    if salt is None:
        salt = K.generate_salt()
        warnings.warn("no salt given; these tokens can't be made again", stacklevel=2)
    K.check_secret(salt)
    reports = scan(df, mode=mode) if reports is None else reports
    names = {c for c in reports if c in df.columns}
    names &= set(columns) if columns is not None else names
    names -= set(exclude or [])
    if risk is not None:
        names = {c for c in names if reports[c].risk_level == risk}
    how = {c: (strategies or {}).get(c) or (BY_RISK[risk] if risk else reports[c].mask_strategy) for c in names}
    hashed = [c for c in df.columns if how.get(c) == "hash"]
    if strict and (twice := already_masked(df, hashed)):
        raise IdempotencyError(f"already masked: {', '.join(twice)}")
    mocked = [c for c in df.columns if how.get(c) == "mock_category" and not reports[c].value_freq]
    for c, freq in frequencies(df, mocked).items():
        reports[c].value_freq = freq
    k = F.col(key) if key else None
    return df.select(*[expression(df, reports[c], salt, seed, k, how[c]).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def secure_join(left: DataFrame, right: DataFrame, on, *, salt: str | None = None, how: str = "inner", kinds: dict[str, str] | None = None, validate: bool = True, suffixes=("_x", "_y")) -> DataFrame:
    """Joins on pseudonyms: both keys become tokens of one salt; without a salt they must be tokens already, and of one salt."""
    keys = [on] if isinstance(on, str) else list(on)
    if salt is not None:
        made = {k: K.token(F.col(k), salt, (kinds or {}).get(k, "generic")) for k in keys}
        left, right = left.withColumns(made), right.withColumns(made)
    elif validate:
        for side in (left, right):
            if len(already_masked(side, keys)) < len(keys):
                raise ValueError("join keys aren't masked; give a salt")
        if left.select(*keys).join(right.select(*keys), keys, "left_semi").isEmpty():
            raise ValueError("no common token: were the sides masked with one salt?")
    return frame.join(left, right, keys, how, suffixes)


def mock_within_group(df: DataFrame, column: str, group_by, key: str, seed: int = 42) -> DataFrame:
    """A column's values shuffled within groups: two row numbers, joined."""
    by = [group_by] if isinstance(group_by, str) else list(group_by)
    a = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    b = df.select(*by, F.col(column).alias("__v"), F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(key, F.lit(seed)), key)).alias("__n"))
    return a.join(b, [*by, "__n"]).withColumn(column, F.col("__v")).select(*df.columns)


def synthetic_people(spark, n: int, seed: int = 42) -> DataFrame:
    """Rows of valid but invented identities, made from the row number alone."""
    d = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    pad = lambda k, w: F.lpad(d(k, 10**w).cast("string"), w, "0")
    names, last = ["Ana", "Bruno", "Carla", "Davi", "Elisa", "Fabio", "Gabriela", "Hugo"], ["Alves", "Barros", "Costa", "Dias", "Esteves", "Freitas"]
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (d(k, len(xs)) + 1).cast("int"))
    df = spark.range(n)
    return df.select(
        "id", F.concat_ws(" ", pick(1, names), pick(2, last)).alias("nome"), K.with_check_digits(pad(3, 9), K.CPF_WEIGHTS).alias("cpf"), K.with_check_digits(pad(4, 12), K.CNPJ_WEIGHTS).alias("cnpj"),
        F.concat(F.lower(pick(1, names)), d(5, 10000).cast("string"), F.lit("@example.org")).alias("email"), F.concat(F.lit("("), (d(6, 89) + 11).cast("string"), F.lit(") 9"), pad(7, 4), F.lit("-"), pad(8, 4)).alias("telefone"),
        F.concat(pad(9, 5), F.lit("-"), pad(10, 3)).alias("cep"), F.date_add(F.to_date(F.lit("1940-01-01")), d(11, 24000).cast("int")).alias("data_nascimento"), pick(12, ["SP", "RJ", "MG", "BA", "RS"]).alias("uf"),
    )


class Synthesizer:
    """Rows that keep each column's distribution and the numeric columns' rank correlations: a Gaussian copula.

    Quantiles and the correlation matrix come from aggregations; rows are drawn in Spark."""

    def __init__(self, grid: int = 64, categories: int = 50, seed: int = 42):
        self.grid, self.categories, self.seed = grid, categories, seed

    def fit(self, df: DataFrame) -> Synthesizer:
        import numpy as np

        from .stats import corr, numeric

        direct = {c for c, r in scan(df).items() if r.is_direct_identifier}
        self.numbers = [c for c in numeric(df) if c not in direct]
        self.texts = [c for c, k in df.dtypes if k == "string" and c not in direct]
        points = [i / self.grid for i in range(self.grid + 1)]
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), points, 10000).alias(c) for c in self.numbers], F.count("*").alias("__n")).first()
        if row["__n"] < 100:
            raise ValueError("100 rows or more are needed")
        self.quantiles = {c: [x for x in row[c]] for c in self.numbers if row[c] is not None}
        self.numbers = [*self.quantiles]
        self.whole = {c: k in ("int", "bigint", "smallint", "tinyint") for c, k in df.dtypes}
        self.shares = frequencies(df, self.texts, self.categories)
        matrix = np.eye(len(self.numbers))
        if len(self.numbers) > 1:
            for r in corr(df, self.numbers).collect():
                i, j = self.numbers.index(r["a"]), self.numbers.index(r["b"])
                matrix[i, j] = matrix[j, i] = 0.0 if r["corr"] is None or r["corr"] != r["corr"] else r["corr"]
        values, vectors = np.linalg.eigh(matrix)
        matrix = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
        scale = np.sqrt(np.diag(matrix))
        self.factor = np.linalg.cholesky(matrix / scale[:, None] / scale[None, :] + 1e-9 * np.eye(len(matrix))) if len(matrix) else matrix
        return self

    def sample(self, spark, n: int) -> DataFrame:
        df = spark.range(n).withColumns({f"__z{i}": F.randn(self.seed + i) for i in range(len(self.numbers))})
        made = {}
        for i, c in enumerate(self.numbers):
            z = sum((F.col(f"__z{j}") * float(self.factor[i, j]) for j in range(i + 1)), F.lit(0.0))
            u = F.lit(1.0) / (1 + F.exp(-1.702 * z))  # near the normal distribution function
            q, at = F.array(*[F.lit(float(x)) for x in self.quantiles[c]]), u * self.grid
            k = F.least(F.floor(at), F.lit(self.grid - 1)).cast("int")
            x = F.element_at(q, k + 1) + (at - k) * (F.element_at(q, k + 2) - F.element_at(q, k + 1))
            made[c] = F.round(x).cast("long") if self.whole[c] else x
        for i, c in enumerate(self.texts):
            made[c] = K.mock_category(F.lit(True), self.shares[c], F.rand(self.seed + 1000 + i))
        return df.withColumns(made).select(*self.numbers, *self.texts)


def clone(df: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    return Synthesizer(seed=seed).fit(df).sample(df.sparkSession, n)


def sandbox(df: DataFrame, n: int = 1000, salt: str | None = None, seed: int = 42) -> DataFrame:
    return mask(clone(df, n, seed), salt=salt, strict=False)
