"""An encrypted, chunked dataset with statistics: Parquet rows of (chunk, statistics, AES-GCM payload) and a signed manifest.

Every chunk is encrypted by itself, bound to its dataset and number, so a read decrypts only chunks whose statistics can
match. Statistics are withheld for raw content. All crypto on rows is Spark's; the driver derives keys and signs."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json
import secrets
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import check_secret
from ..plans.predicates import from_normalized, may_hold, normalize_filters

VERSION = 1
ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


class ExpiredFileError(PermissionError):
    """The dataset's time is over."""


def hkdf(key: bytes, salt: bytes, info: bytes, n: int = 32) -> bytes:
    prk, out, block = hmac.new(salt, key, hashlib.sha256).digest(), b"", b""
    for i in range(-(-n // 32)):
        block = hmac.new(prk, block + info + bytes([i + 1]), hashlib.sha256).digest()
        out += block
    return out[:n]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    files, p = _fs(spark, path)
    out = files.create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    files, p = _fs(spark, path)
    if not files.exists(p):
        raise FileNotFoundError(path)
    rows = spark.read.text(path, wholetext=True).first()
    return rows[0]


def exists(spark: SparkSession, path: str) -> bool:
    files, p = _fs(spark, path)
    return files.exists(p)


def _sign(key: bytes, manifest: dict) -> str:
    body = {k: v for k, v in manifest.items() if k != "signature"}
    return hmac.new(key, json.dumps(body, sort_keys=True, ensure_ascii=False).encode(), hashlib.sha256).hexdigest()


def _keys(key: str | bytes, salt: bytes, level: str = "") -> tuple[bytes, bytes]:
    raw = check_secret(key, "key")
    return hkdf(raw, salt, b"data:" + level.encode()), hkdf(raw, salt, b"sign")


#: Timestamps keep their microseconds in chunks.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write(df: DataFrame, path: str, key: str | bytes | None = None, *, raw: bool = False, chunk_rows: int = 50_000, order_by: list[str] | None = None, label: str = "", metadata: dict | None = None, expires_at: str | None = None, overwrite: bool = False, level: str = "", content: str = "table") -> None:
    """Writes df; rows go into chunks of about chunk_rows by order_by (range-partitioned), which makes statistics sharp.
    Rows that tie in order_by are spread over as many chunks as they need.

    raw content keeps no statistics. Without a key the dataset is only signed (open variant)."""
    spark = df.sparkSession
    if exists(spark, f"{path}/manifest.json") and not overwrite:
        raise FileExistsError(path)
    salt, ident = secrets.token_bytes(16), uuid.uuid4().hex
    data_key, sign_key = _keys(key, salt, level) if key is not None else (None, b"open")
    n = df.count()
    chunks = max(1, -(-n // chunk_rows))
    ordered = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(chunks, *order_by, "__tie").drop("__tie") if order_by else df.repartition(chunks)
    held = [] if raw else [f.name for f in df.schema.fields if isinstance(f.dataType, ORDERED)]
    stats = F.struct(*[F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")).alias(c) for c in held]) if held else F.lit(None).cast("struct<none:int>")
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false", **TIMES})
    rows = ordered.withColumn("__chunk", F.spark_partition_id())
    out = rows.groupBy("__chunk").agg(F.count("*").alias("n_rows"), stats.alias("stats"), F.to_json(F.collect_list(body)).alias("__body"))
    payload = F.encode("__body", "UTF-8")
    if data_key is not None:
        aad = F.concat(F.lit(ident + ":"), F.col("__chunk").cast("string"))
        payload = F.aes_encrypt(payload, F.lit(bytearray(data_key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.encode(aad, "UTF-8"))
    out = out.select(F.col("__chunk").alias("chunk"), "n_rows", "stats", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    out.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/chunks")
    digests = spark.read.parquet(f"{path}/chunks").select("chunk", "digest").orderBy("chunk").collect()  # a row per chunk
    manifest = {
        "version": VERSION, "id": ident, "salt": base64.b64encode(salt).decode(), "content": content, "raw": raw, "encrypted": key is not None, "level": level, "label": label, "metadata": metadata or {}, "expires_at": expires_at,
        "created_at": dt.datetime.now(dt.timezone.utc).isoformat(), "schema": df.schema.jsonValue(), "n_rows": n, "chunks": len(digests), "stats": held, "digest": hashlib.sha256("".join(f"{r['chunk']}:{r['digest']};" for r in digests).encode()).hexdigest(),
    }
    manifest["signature"] = _sign(sign_key, manifest)
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, ensure_ascii=False))


def inspect(spark: SparkSession, path: str, key: str | bytes | None = None) -> dict:
    """The manifest, its signature checked if there is a key; no payload is read."""
    m = json.loads(_read_text(spark, f"{path}/manifest.json"))
    if key is not None or not m["encrypted"]:
        sign_key = _keys(key, base64.b64decode(m["salt"]))[1] if m["encrypted"] else b"open"
        if not hmac.compare_digest(_sign(sign_key, m), m["signature"]):
            raise ValueError("wrong key, or the manifest was changed")
    return m


def verify(spark: SparkSession, path: str, key: str | bytes | None = None) -> bool:
    """Whether manifest and chunks are as they were written; nothing is decrypted."""
    try:
        m = inspect(spark, path, key)
    except ValueError:
        return False
    rows = spark.read.parquet(f"{path}/chunks").select("chunk", "digest", F.sha2("payload", 256).alias("now")).orderBy("chunk").collect()
    return all(r["digest"] == r["now"] for r in rows) and hashlib.sha256("".join(f"{r['chunk']}:{r['digest']};" for r in rows).encode()).hexdigest() == m["digest"]


def _check_expiry(m: dict) -> None:
    if m.get("expires_at"):
        try:
            end = dt.datetime.fromisoformat(m["expires_at"])
        except ValueError:
            warnings.warn("the expiry date can't be read", stacklevel=3)
            return
        end = end if end.tzinfo else end.replace(tzinfo=dt.timezone.utc)
        if dt.datetime.now(dt.timezone.utc) > end:
            raise ExpiredFileError(f"expired at {m['expires_at']}")


def prune(chunks: DataFrame, filters: list[tuple], held: list[str]) -> DataFrame:
    """The chunks whose statistics can match."""
    at = lambda what: lambda c: F.col("stats")[c][what] if c in held else None
    return chunks.where(may_hold(filters, at("min"), at("max"), lambda c: F.col("stats")[c]["nulls"], lambda c: F.col("n_rows")))


def read(spark: SparkSession, path: str, key: str | bytes | None = None, *, columns: list[str] | None = None, filters: dict | None = None) -> DataFrame:
    """The rows; chunks that no filter can match aren't decrypted, filters hold on all columns, then columns are kept."""
    m = inspect(spark, path, key)
    if m["encrypted"] and key is None:
        raise PermissionError("a key is needed")
    _check_expiry(m)
    schema, wanted = T.StructType.fromJson(m["schema"]), normalize_filters(filters)
    chunks = prune(spark.read.parquet(f"{path}/chunks"), wanted, m["stats"])
    payload = F.col("payload")
    if m["encrypted"]:
        data_key = _keys(key, base64.b64decode(m["salt"]), m["level"])[0]
        aad = F.concat(F.lit(m["id"] + ":"), F.col("chunk").cast("string"))
        payload = F.aes_decrypt(payload, F.lit(bytearray(data_key)), F.lit("GCM"), F.lit("DEFAULT"), F.encode(aad, "UTF-8"))
    needed = set(schema.names) if columns is None else set(columns) | {c for c, _, _ in wanted}
    part = T.StructType([f for f in schema.fields if f.name in needed])
    lines = chunks.select(F.explode(F.from_json(F.decode(payload, "UTF-8"), T.ArrayType(T.StringType()))).alias("line"))
    out = lines.select(F.from_json("line", part, TIMES).alias("r")).select("r.*").where(from_normalized(wanted))
    return out.select(*columns) if columns is not None else out


def write_bytes(spark: SparkSession, data: bytes, path: str, key, **kw) -> None:
    write(spark.createDataFrame([(base64.b64encode(data).decode(),)], "data string"), path, key, raw=True, content="bytes", **kw)


def read_bytes(spark: SparkSession, path: str, key) -> bytes:
    return base64.b64decode(read(spark, path, key).first()["data"])


def write_frames(frames: dict[str, DataFrame], path: str, key, *, levels: dict[str, str] | None = None, overwrite: bool = False, **kw) -> None:
    """Several frames in one bundle, each under a key of its access level."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        write(df, f"{path}/frames/{name}", key, level=(levels or {}).get(name, ""), overwrite=overwrite, **kw)
    _write_text(spark, f"{path}/bundle.json", json.dumps({n: (levels or {}).get(n, "") for n in frames}))


def frame_names(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(_read_text(spark, f"{path}/bundle.json"))


def read_frames(spark: SparkSession, path: str, key, allowed: list[str] | None = None) -> dict[str, DataFrame]:
    """The frames, or with allowed only those of these levels; none at all is an error."""
    names = {n: level for n, level in frame_names(spark, path).items() if allowed is None or level in ("", *allowed)}
    if not names:
        raise PermissionError("no frame of these levels")
    return {n: read(spark, f"{path}/frames/{n}", key) for n in names}


def read_frame(spark: SparkSession, path: str, key, name: str, allowed: list[str] | None = None) -> DataFrame:
    level = frame_names(spark, path)[name]
    if allowed is not None and level not in ("", *allowed):
        raise PermissionError(name)
    return read(spark, f"{path}/frames/{name}", key)


def rekey(spark: SparkSession, path: str, old_key, new_key, output: str) -> None:
    """The dataset under another key, elsewhere."""
    m = inspect(spark, path, old_key)
    write(read(spark, path, old_key), output, new_key, raw=m["raw"], label=m["label"], metadata=m["metadata"], expires_at=m["expires_at"], level=m["level"], content=m["content"])


# -- key pairs, by the JVM's own cryptography


def generate_keypair(spark: SparkSession, size: int = 2048) -> tuple[str, str]:
    """An RSA pair as PEM text: (private, public)."""
    g = spark._jvm.java.security.KeyPairGenerator.getInstance("RSA")
    g.initialize(size)
    pair = g.generateKeyPair()
    pem = lambda raw, name: f"-----BEGIN {name}-----\n" + base64.encodebytes(bytes(raw)).decode() + f"-----END {name}-----\n"
    # the keys' own classes are closed to reflection; their specifications aren't
    factory, named = spark._jvm.java.security.KeyFactory.getInstance("RSA"), spark._jvm.java.lang.Class.forName
    private = factory.getKeySpec(pair.getPrivate(), named("java.security.spec.PKCS8EncodedKeySpec")).getEncoded()
    return pem(private, "PRIVATE KEY"), pem(factory.getKeySpec(pair.getPublic(), named("java.security.spec.X509EncodedKeySpec")).getEncoded(), "PUBLIC KEY")


def _unpem(text: str) -> bytearray:
    return bytearray(base64.b64decode("".join(x for x in text.splitlines() if "-----" not in x)))


def wrap_key(spark: SparkSession, data_key: bytes, public_pem: str) -> str:
    jvm = spark._jvm
    public = jvm.java.security.KeyFactory.getInstance("RSA").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(_unpem(public_pem)))
    c = jvm.javax.crypto.Cipher.getInstance("RSA/ECB/OAEPWithSHA-256AndMGF1Padding")
    c.init(1, public)
    return base64.b64encode(bytes(c.doFinal(bytearray(data_key)))).decode()


def unwrap_key(spark: SparkSession, wrapped: str | list[str], private_pem: str) -> bytes:
    """The key from a wrapped copy, or from whichever of several is for this pair."""
    jvm = spark._jvm
    private = jvm.java.security.KeyFactory.getInstance("RSA").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(_unpem(private_pem)))
    last: Exception | None = None
    for w in [wrapped] if isinstance(wrapped, str) else wrapped:
        try:
            c = jvm.javax.crypto.Cipher.getInstance("RSA/ECB/OAEPWithSHA-256AndMGF1Padding")
            c.init(2, private)
            return bytes(c.doFinal(bytearray(base64.b64decode(w))))
        except Exception as e:  # noqa: BLE001  another recipient's copy
            last = e
    raise PermissionError("no copy of the key is for this pair") from last
