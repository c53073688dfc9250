"""Masked SQL: a query analysed by Spark with masks over its output, and view texts for other databases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import ColumnReport

# Expressions by strategy and dialect.
TEMPLATES = {
    "hash": {
        "postgresql": "encode(hmac({col}::text, {salt}, 'sha256'), 'hex')", "mysql": "SHA2(CONCAT({col}, {salt}), 256)", "sqlite": "hex({col} || {salt})", "sqlserver": "CONVERT(VARCHAR(64), HASHBYTES('SHA2_256', CAST({col} AS NVARCHAR) + {salt}), 2)",
        "bigquery": "TO_HEX(SHA256(CONCAT(CAST({col} AS STRING), {salt})))", "duckdb": "hex(sha256(CONCAT({col}::TEXT, {salt})))", "spark": "sha2(concat(cast({col} AS STRING), {salt}), 256)",
    },
    "redact": {"sqlserver": "N'REDACTED'", "": "'REDACTED'"},
    "truncate": {
        "postgresql": "CONCAT(LEFT({col}::text, 5), '-XXX')", "mysql": "CONCAT(LEFT({col}, 5), '-XXX')", "sqlite": "SUBSTR({col}, 1, 5) || '-XXX'", "sqlserver": "CONCAT(LEFT(CAST({col} AS VARCHAR), 5), '-XXX')",
        "bigquery": "CONCAT(SUBSTR(CAST({col} AS STRING), 1, 5), '-XXX')", "duckdb": "CONCAT(SUBSTR({col}::TEXT, 1, 5), '-XXX')", "spark": "concat(substr(cast({col} AS STRING), 1, 5), '-XXX')",
    },
    "generalize_date": {
        "postgresql": "TO_CHAR({col}, 'YYYY-MM') || '-XX'", "mysql": "DATE_FORMAT({col}, '%Y-%m-XX')", "sqlite": "SUBSTR({col}, 1, 7) || '-XX'", "sqlserver": "FORMAT({col}, 'yyyy-MM') + '-XX'",
        "bigquery": "CONCAT(FORMAT_DATE('%Y-%m', {col}), '-XX')", "duckdb": "STRFTIME({col}::DATE, '%Y-%m') || '-XX'", "spark": "concat(date_format({col}, 'yyyy-MM'), '-XX')",
    },
    "mask_phone_ddd": {
        "postgresql": "CONCAT('(', LEFT({col}::text, 2), ') XXXXX-XXXX')", "mysql": "CONCAT('(', LEFT({col}, 2), ') XXXXX-XXXX')", "sqlite": "'(' || SUBSTR({col}, 1, 2) || ') XXXXX-XXXX'", "sqlserver": "CONCAT('(', LEFT(CAST({col} AS VARCHAR), 2), ') XXXXX-XXXX')",
        "bigquery": "CONCAT('(', SUBSTR(CAST({col} AS STRING), 1, 2), ') XXXXX-XXXX')", "duckdb": "CONCAT('(', SUBSTR({col}::TEXT, 1, 2), ') XXXXX-XXXX')", "spark": "concat('(', substr(cast({col} AS STRING), 1, 2), ') XXXXX-XXXX')",
    },
    "suppress": {"": "NULL"},
    "mock_category": {"": "'CATEGORIA_MOCK'"},
    "mock_numeric": {"postgresql": "{col} * (0.9 + random() * 0.2)", "": "{col} * (0.9 + rand() * 0.2)"},
    "passthrough": {"": "{col}"},
}
DIALECTS = ("postgresql", "mysql", "sqlite", "sqlserver", "bigquery", "duckdb", "spark")


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def expression(column: str, strategy: str, dialect: str, salt: str) -> str:
    if dialect not in DIALECTS:
        raise ValueError(f"no dialect: {dialect}")
    by = TEMPLATES.get(strategy, TEMPLATES["hash"])
    return by.get(dialect, by.get("", "")).format(col=column, salt=literal(salt))


def masked_query(spark: SparkSession, query: str, reports: dict[str, ColumnReport], salt: str, **frames: DataFrame) -> DataFrame:
    """Runs a query with masks over the columns of its analysed output: stars, aliases and qualified names all resolve."""
    df = run_sql(spark, query, **frames)
    return df.select(*[F.expr(expression(f"`{c}`", reports[c].mask_strategy, "spark", salt)).alias(c) if c in reports else F.col(f"`{c}`") for c in df.columns])


def view_sql(table: str, columns: list[str], reports: dict[str, ColumnReport], dialect: str = "postgresql", salt: str = "", view: str | None = None, annotate: bool = True) -> str:
    """CREATE VIEW text that masks a table's columns."""
    lines = [f"    {expression(c, reports[c].mask_strategy, dialect, salt)} AS {c}" + (f" /* {reports[c].pii_type}, {reports[c].risk_level} */" if annotate else "") if c in reports else f"    {c}" for c in columns]
    create = "CREATE VIEW" if dialect in ("sqlite", "sqlserver") else "CREATE OR REPLACE VIEW"
    return f"{create} {view or table + '_masked'} AS\nSELECT\n" + ",\n".join(lines) + f"\nFROM {table};"


def update_sql(table: str, reports: dict[str, ColumnReport], dialect: str, salt: str) -> list[str]:
    """UPDATE texts that mask a table in place."""
    return [f"UPDATE {table} SET {c} = {expression(c, r.mask_strategy, dialect, salt)} WHERE {c} IS NOT NULL;" for c, r in reports.items()]


def grant_sql(view: str, table: str, role: str = "dev_role") -> str:
    return f"REVOKE ALL ON {table} FROM {role};\nGRANT SELECT ON {view} TO {role};"


def masked_view(df: DataFrame, name: str, reports: dict[str, ColumnReport], salt: str) -> DataFrame:
    """A temporary view over df with masked columns."""
    out = df.select(*[F.expr(expression(f"`{c}`", reports[c].mask_strategy, "spark", salt)).alias(c) if c in reports else F.col(f"`{c}`") for c in df.columns])
    out.createOrReplaceTempView(name)
    return out


def run_sql(spark: SparkSession, query: str, **frames) -> DataFrame:
    """SQL over named frames or paths; read_parquet('x') and the like become file tables."""
    from ..sources.files import read_file

    for name, source in frames.items():
        (source if isinstance(source, DataFrame) else read_file(spark, source)).createOrReplaceTempView(name)
    query = re.sub(r"read_(parquet|csv|json)(?:_auto)?\(\s*'([^']+)'\s*\)", lambda m: f"{m[1]}.`{m[2]}`", query)
    return spark.sql(query)
