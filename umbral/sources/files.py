"""Readers and writers by extension, partial reads, databases, directory inventories."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.detect import RISKS, scan
from ..plans.predicates import predicate

SPARK_FORMATS = {".parquet": "parquet", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text", ".avro": "avro", ".xml": "xml"}
ARROW = (".feather", ".ipc", ".arrow")
PANDAS = {".xlsx": "read_excel", ".xls": "read_excel", ".ods": "read_excel", ".html": "read_html", ".dta": "read_stata", ".sas7bdat": "read_sas", ".xpt": "read_sas", ".sav": "read_spss", ".hdf": "read_hdf", ".h5": "read_hdf"}
MAGIC = {b"PAR1": ".parquet", b"ARRO": ".arrow", b"PK\x03\x04": ".xlsx", b"ORC": ".orc", b"Obj\x01": ".avro"}


def extension(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext or not os.path.isfile(path):
        return ext
    with open(path, "rb") as f:
        first = f.read(8)
    return next((e for m, e in MAGIC.items() if first.startswith(m)), "")


def encoding_of(path: str) -> str:
    """UTF-8 if the first megabyte reads as such, else Latin-1."""
    try:
        with open(path, "rb") as f:
            f.read(1 << 20).decode("utf-8", "strict")
    except UnicodeDecodeError as e:
        return "UTF-8" if e.end >= (1 << 20) - 4 else "ISO-8859-1"
    except OSError:
        pass
    return "UTF-8"


def read(spark: SparkSession, source, *, columns: list[str] | None = None, filters: dict | None = None, salt: str | None = None, key=None, schema=None, **options) -> DataFrame:
    """A DataFrame from a DataFrame, a table name, a sealed dataset or a file; filters and columns reach the scan; salt masks."""
    from ..operators.mask import mask
    from . import sealed

    if isinstance(source, DataFrame):
        df = source
    elif key is not None or os.path.exists(os.path.join(str(source), "manifest.json")):
        df = sealed.read(spark, source, key, columns=columns, filters=filters)
        filters = None
    else:
        df = read_file(spark, source, schema=schema, **options)
    df = df.where(predicate(df, filters)) if filters else df
    df = df.select(*columns) if columns else df
    return mask(df, salt=salt) if salt else df


def read_file(spark: SparkSession, path: str, *, schema=None, widths: list[tuple[str, int]] | None = None, **options) -> DataFrame:
    ext = extension(path)
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    if widths is not None:
        df, at, made = spark.read.text(path), 1, []
        for name, n in widths:
            made.append(F.trim(F.substring("value", at, n)).alias(name))
            at += n
        return df.select(*made)
    if ext in (".csv", ".tsv"):
        base = {"header": "true", "sep": "\t" if ext == ".tsv" else ",", "encoding": encoding_of(path)} | ({"inferSchema": "true"} if schema is None else {})
        return spark.read.options(**(base | options)).csv(path, schema=schema)
    if ext in SPARK_FORMATS:
        return reader.format(SPARK_FORMATS[ext]).load(path)
    if ext in ARROW:
        return read_arrow(spark, path)
    if ext in PANDAS:
        import pandas as pd

        out = getattr(pd, PANDAS[ext])(path, **options)
        return spark.createDataFrame(out[0] if isinstance(out, list) else out)
    if not ext and spark.catalog.tableExists(path):
        return spark.table(path)
    return reader.parquet(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow or Feather file, one task per record batch; the path must be readable by executors."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    with pa.memory_map(path) as f, pa.ipc.open_file(f) as r:
        n, schema = r.num_record_batches, from_arrow_schema(r.schema)

    def run(batches):
        with pa.memory_map(path) as f, pa.ipc.open_file(f) as r:
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield r.get_batch(i)

    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)


def write(df: DataFrame, path: str, *, mode: str = "errorifexists", partition_by=None, **options) -> None:
    ext = extension(path)
    if ext in ARROW:
        import pyarrow as pa
        from pyarrow import feather

        feather.write_feather(pa.Table.from_batches(df.toArrow().to_batches()), path)
        return
    w = df.write.mode(mode).options(**options)
    w = w.partitionBy(partition_by) if partition_by else w
    if ext in (".csv", ".tsv"):
        w.options(**({"header": "true", "sep": "\t" if ext == ".tsv" else ","} | options)).csv(path)
    else:
        w.format(SPARK_FORMATS.get(ext, "parquet")).save(path)


# -- partial reads


def header(spark: SparkSession, path: str) -> dict:
    """Rows, row groups and per-column type, nulls, least and largest value from Parquet footers alone."""
    import pyarrow.parquet as pq

    files = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet")] if os.path.isdir(path) else [path]
    rows, groups, cols = 0, 0, {}
    for name in files:
        m = pq.ParquetFile(name).metadata
        rows, groups = rows + m.num_rows, groups + m.num_row_groups
        for g in range(m.num_row_groups):
            for i in range(m.num_columns):
                c = m.row_group(g).column(i)
                one = cols.setdefault(c.path_in_schema, {"type": c.physical_type, "nulls": 0, "min": None, "max": None})
                if c.statistics is not None:
                    one["nulls"] += c.statistics.null_count or 0
                    if c.statistics.has_min_max:
                        one["min"] = c.statistics.min if one["min"] is None else min(one["min"], c.statistics.min)
                        one["max"] = c.statistics.max if one["max"] is None else max(one["max"], c.statistics.max)
    return {"rows": rows, "row_groups": groups, "columns": cols}


def _chunks(df: DataFrame, picked: list[int], n_chunks: int) -> DataFrame:
    """Rows of the picked chunks in reading order: rows are numbered within the blocks that tasks read, and blocks by a row each.

    Works for every format; files go by path. The numbers hold as long as the files don't change."""
    kept = df.columns
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")] if _has_files(df) else [F.lit("").alias("__file"), F.spark_partition_id().cast("long").alias("__start")]
    rows = df.select("*", *block, F.monotonically_increasing_id().alias("__at"))
    blocks = rows.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("__file").alias("__f"), F.col("__start").alias("__s"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    size = F.greatest(F.lit(1), F.floor(F.col("__all") / n_chunks))
    part = F.least(F.floor((F.col("__base") + F.col("__at") - F.col("__first")) / size), F.lit(n_chunks - 1)) + 1
    return rows.join(blocks, (F.col("__file") == F.col("__f")) & (F.col("__start") == F.col("__s"))).where(part.isin(picked)).select(*kept)


def _has_files(df: DataFrame) -> bool:
    """Whether rows know the files that they are from; those of Arrow files and pandas readers don't."""
    try:
        df.select("_metadata.file_path").schema
    except AnalysisException:
        return False
    return True


def profile(spark: SparkSession, source, *, head: int = 5, approx: bool = False, score: bool = True, **options) -> dict:
    """shape, dtypes, nulls, distinct counts, describe, first rows and privacy score of anything that read() takes."""
    from ..operators import metrics, stats

    df = read(spark, source, **options)
    columns = {r["column"]: r for r in stats.profile_columns(df, approx=approx).collect()}
    out = {
        "shape": stats.shape(df), "dtypes": dict(df.dtypes), "nulls": {c: columns[c]["nulls"] for c in df.columns}, "distinct": {c: columns[c]["n_unique"] for c in df.columns},
        "describe": [r.asDict() for r in stats.describe(df).collect()] if stats.numeric(df) else [], "head": [r.asDict(recursive=True) for r in df.limit(head).collect()],
    }
    return out | ({"score": metrics.privacy_score(df, scan(df))} if score else {})


def header_frame(spark: SparkSession, path: str) -> DataFrame:
    """column, type, nulls, least and largest value (as text), rows, from Parquet footers alone."""
    found = header(spark, path)
    rows = [(c, x["type"], x["nulls"], *(None if x[k] is None else str(x[k]) for k in ("min", "max")), found["rows"]) for c, x in found["columns"].items()]
    return spark.createDataFrame(rows, "column string, type string, nulls long, least string, largest string, rows long")


def read_partial(spark: SparkSession, path: str, *, header_only: bool = False, head: int | None = None, tail: int | None = None, columns=None, n_chunks: int | None = None, chunks=None, sample: int | None = None, sample_seed: int = 42, order_by=None):
    """The header, the first or last rows, a sample, or chunks (from 1) of n_chunks by row number."""
    from ..operators import frame

    if header_only:
        return header(spark, path) if extension(path) == ".parquet" else read_file(spark, path).schema
    df = read_file(spark, path)
    if chunks is not None:
        if n_chunks is None:
            raise ValueError("chunks need n_chunks")
        picked = [chunks] if isinstance(chunks, int) else list(chunks)
        if any(not 1 <= c <= n_chunks for c in picked):
            raise ValueError(f"chunks go from 1 to {n_chunks}")
        df = _chunks(df, picked, n_chunks)
    df = df.select(*columns) if columns else df
    if sample is not None:
        return frame.sample(df, sample, seed=sample_seed)
    if head is not None:
        return frame.head(df, head, order_by)
    return frame.tail(df, tail, order_by) if tail is not None else df


def iter_chunks(df: DataFrame, rows: int = 10_000):
    """pandas frames of so many rows, one partition at a time on the driver."""
    import pandas as pd

    held = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict())
        if len(held) == rows:
            yield pd.DataFrame(held)
            held = []
    if held:
        yield pd.DataFrame(held)


def csv_index(path: str, n_chunks: int = 10) -> dict:
    """Where chunks of a CSV start, at line starts; kept beside the file. Spark splits need no such index."""
    size, out = os.path.getsize(path), []
    with open(path, "rb") as f:
        start = len(f.readline())
        for i in range(n_chunks):
            f.seek(start + (size - start) * i // n_chunks)
            if i:
                f.readline()
            out.append(min(f.tell(), size))
    index = {"offsets": out, "header_end": start, "size": size, "mtime": os.path.getmtime(path)}
    with open(path + ".index.json", "w") as f:
        json.dump(index, f)
    return index


# -- databases


class Database:
    """JDBC options and the reads and writes over them; the password is never shown."""

    def __init__(self, spark: SparkSession, url: str, **properties):
        self.spark, self.url, self.properties = spark, url, properties

    def __repr__(self) -> str:
        return f"Database({self.url.split('?')[0].split('//')[-1].split('@')[-1]})"

    @property
    def dialect(self) -> str:
        return self.url.removeprefix("jdbc:").split(":")[0]

    def read(self, table_or_sql: str, *, columns=None, where=None, head=None, sample=None, salt=None, partition: tuple | None = None) -> DataFrame:
        """Selections, filters and limits go to the database; partition: (column, low, high, n) reads in parallel."""
        from ..operators.mask import mask

        opts = dict(self.properties) | {"url": self.url}
        opts |= {"query": table_or_sql} if " " in table_or_sql.strip() else {"dbtable": table_or_sql}
        if partition:
            opts |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True))
        df = self.spark.read.format("jdbc").options(**opts).load()
        df = df.where(predicate(df, where)) if where is not None else df
        df = df.select(*columns) if columns else df
        df = df.sample(sample) if sample else df
        df = df.limit(head) if head else df
        return mask(df, salt=salt) if salt else df

    def write(self, df: DataFrame, table: str, *, mode: str = "append", salt=None, batch: int = 10_000) -> None:
        from ..operators.mask import mask

        (mask(df, salt=salt) if salt else df).write.mode(mode).option("batchsize", batch).jdbc(self.url, table, properties=self.properties)


def upsert(target: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """target with rows put in place of those with their keys."""
    return target.join(rows.select(*on), on, "left_anti").unionByName(rows, allowMissingColumns=True)


def write_masked_table(spark: SparkSession, source: str, target: str, salt: str, where=None) -> None:
    from ..operators.mask import mask

    df = spark.table(source)
    df = df.where(predicate(df, where)) if where is not None else df
    mask(df, salt=salt).write.mode("overwrite").saveAsTable(target)


# -- inventories


def inventory(spark: SparkSession, path: str, *, extensions=None, recursive: bool = True, min_risk: str | None = None, max_files: int | None = None, sample_size: int | None = None, skip_errors: bool = True) -> DataFrame:
    """file, column, pii_type, risk_level, mask_strategy, match_ratio of the files under a folder; of a file that can't be read, its error."""
    known = set(extensions or [*SPARK_FORMATS, ".csv", ".tsv", *ARROW])
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if os.path.splitext(f)[1].lower() in known and (recursive or d == path)]
    rows = []
    for name in sorted(files)[:max_files]:
        try:
            for r in scan(read_file(spark, name), sample_size=sample_size).values():
                if min_risk is None or RISKS[r.risk_level] <= RISKS[min_risk]:
                    rows.append((os.path.relpath(name, path), r.column, r.pii_type, r.risk_level, r.mask_strategy, float(r.match_ratio), None))
        except Exception as e:
            if not skip_errors:
                raise
            rows.append((os.path.relpath(name, path), None, None, None, None, None, f"{type(e).__name__}: {e}".split("\n")[0]))
    return spark.createDataFrame(rows, "file string, column string, pii_type string, risk_level string, mask_strategy string, match_ratio double, error string")
