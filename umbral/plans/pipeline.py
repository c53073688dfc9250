"""A fluent chain over one frame, and the one-call pipeline."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.detect import scan
from ..operators import frame
from ..operators import metrics
from ..operators.mask import mask
from ..operators.quality import ValidationReport, validate
from .lineage import Lineage
from .sqlmask import run_sql

STEPS = ("where", "select", "drop", "rename", "sort", "groupby", "add_column", "cast", "fill_null", "clip", "unique", "head", "tail", "sample", "top_n", "shift", "lag", "lead", "pivot", "melt", "explode", "join")


class Pipeline:
    """pipe(spark, source).where(...).mask(salt=...).groupby(...).df: nothing runs before an action."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __getattr__(self, name: str):
        if name not in STEPS:
            raise AttributeError(name)
        f = getattr(frame, name)
        return lambda *a, **k: Pipeline(f(self.df, *a, **k))

    def mask(self, **k) -> Pipeline:
        return Pipeline(mask(self.df, **k))

    def sql(self, query: str, name: str = "self") -> Pipeline:
        return Pipeline(run_sql(self.df.sparkSession, query, **{name: self.df}))

    def write(self, path: str, **k) -> Pipeline:
        from ..sources.files import write

        write(self.df, path, **k)
        return self

    def store(self, path: str, key, **k) -> Pipeline:
        from ..sources.sealed import write

        write(self.df, path, key, **k)
        return self

    def collect(self):
        return self.df.collect()

    def to_pandas(self):
        return self.df.toPandas()


def pipe(spark: SparkSession, source, **k) -> Pipeline:
    from ..sources.files import read

    return Pipeline(read(spark, source, **k))


@dataclass
class ProcessResult:
    df: DataFrame
    reports: dict
    validation: ValidationReport | None
    score: dict | None
    lineage: Lineage
    seconds: float
    output: str | None = None
    steps: list[str] = field(default_factory=list)


def process(spark: SparkSession, source, *, salt: str | None = None, where=None, select=None, add_columns: dict | None = None, rules: dict | None = None, risk: str | None = None, columns=None, exclude=None, profile: bool = False, output: str | None = None, key=None, overwrite: bool = False) -> ProcessResult:
    """read, filter, select, add, scan, validate (before masking; failures don't stop), mask, score, write, with lineage."""
    from ..sources import sealed
    from ..sources.files import read, write

    began, lineage, steps = time.time(), Lineage("process"), ["read"]
    df = read(spark, source)
    if where is not None:
        df, steps = frame.where(df, where), [*steps, "where"]
    if select is not None:
        df, steps = frame.select(df, select), [*steps, "select"]
    if add_columns:
        df, steps = frame.add_column(df, **add_columns), [*steps, "add_columns"]
    reports = scan(df)
    lineage.origin(df, str(source) if isinstance(source, str) else "frame")
    validation = validate(df, rules) if rules else None
    if salt:
        df = mask(df, salt=salt, reports=reports, risk=risk, columns=columns, exclude=exclude)
        lineage.step(df, "mask", masked=[c for c in reports if c in df.columns])
        steps.append("mask")
    score = metrics.privacy_score(df, reports) if profile else None
    if output:
        sealed.write(df, output, key, overwrite=overwrite) if key else write(df, output, mode="overwrite" if overwrite else "errorifexists")
        lineage.step(df, "export", detail=output)
        steps.append("write")
    return ProcessResult(df, reports, validation, score, lineage, time.time() - began, output, steps)
