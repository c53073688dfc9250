"""Leak tracing: canary rows, text watermarks, embedding watermarks, and the manifest that finds their origin."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "__canary_sig__"
#: Zero-width characters, for 0 and 1, around a marker.
ZERO, ONE, EDGE = "​", "‌", "⁠"


def fingerprint(salt: str, pipeline: str, index: int) -> str:
    return hmac.new(salt.encode(), f"{pipeline}:{index}".encode(), hashlib.sha256).hexdigest()[:16]


def canary_rows(df: DataFrame, pipeline: str, salt: str, n: int = 3) -> tuple[DataFrame, list[str]]:
    """n rows that look like df's, each with a fingerprint: e-mail-like, name-like and number-like columns carry it."""
    prints = [fingerprint(salt, pipeline, i) for i in range(n)]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType,))]
    others = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))]
    shares = [(int(p, 16) % 10_000) / 10_000 for p in prints]
    aggs = [F.percentile_approx(F.col(c).cast("double"), shares).alias(f"n{i}") for i, c in enumerate(numbers)] + [F.min(c).alias(f"o{i}") for i, c in enumerate(others)]
    row = df.agg(*aggs).first() if aggs else None
    out = []
    for k, p in enumerate(prints):
        values = []
        for f in df.schema.fields:
            low = f.name.lower()
            if f.name in numbers:
                v = row[f"n{numbers.index(f.name)}"]
                v = None if v is None else v[k]
                v = int(v) if v is not None and isinstance(f.dataType, T.IntegralType) else v
            elif isinstance(f.dataType, T.StringType):
                v = f"{p[:8]}@canary.invalid" if "mail" in low else f"Canary {p[:8]}" if "name" in low or "nome" in low else p[:8]
            elif isinstance(f.dataType, T.BooleanType):
                v = False
            else:
                v = row[f"o{others.index(f.name)}"]
            values.append(v)
        out.append((*values, p))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], T.StructField(MARK, T.StringType())])
    return df.sparkSession.createDataFrame(out, schema), prints


def inject_canary(df: DataFrame, pipeline: str, salt: str, n: int = 3, keep_mark: bool = True) -> tuple[DataFrame, dict]:
    """df with canary rows and, unless left out, the column that marks them; and the manifest entry."""
    rows, prints = canary_rows(df, pipeline, salt, n)
    out = df.withColumn(MARK, F.lit(None).cast("string")).unionByName(rows)
    return (out if keep_mark else out.drop(MARK)), {"pipeline": pipeline, "fingerprints": prints, "short": [p[:8] for p in prints]}


def strip_canary(df: DataFrame) -> DataFrame:
    return df.where(F.col(MARK).isNull()).drop(MARK) if MARK in df.columns else df


def extract_token(text: str) -> str:
    """The 16- or 8-digit fingerprint in a leaked value."""
    m = re.search(r"\b([0-9a-f]{16}|[0-9a-f]{8})\b", text.lower())
    return m.group(1) if m else text


def save_manifest(path: str, entry: dict) -> None:
    with open(path, "a") as f:
        f.write(json.dumps(entry) + "\n")


def check(token: str, path: str) -> dict | None:
    """The manifest entry that a leaked value leads to."""
    t = extract_token(token)
    with open(path) as f:
        for line in f:
            e = json.loads(line)
            if t in e.get("fingerprints", []) or t in e.get("short", []):
                return e
    return None


def check_corpus(corpus: str, path: str) -> list[dict]:
    with open(path) as f:
        return [e for e in map(json.loads, f) if e.get("corpus") == corpus]


def marker(sig: str) -> str:
    """An invisible string that spells a fingerprint's first 32 bits."""
    return EDGE + "".join(ONE if b == "1" else ZERO for b in f"{int(sig[:8], 16):032b}") + EDGE


def watermark_texts(df: DataFrame, text: str, key: str, corpus: str, salt: str, n: int = 3) -> tuple[DataFrame, dict]:
    """Adds to n documents, spread by a hash of their key, a made-up fact and an invisible marker. Returns the manifest entry too."""
    prints = [fingerprint(salt, corpus, i) for i in range(n)]
    facts = [f" The registry of {p[:6]} lists {int(p[6:10], 16)} entries." for p in prints]
    total = df.count()
    order = df.select(F.col(key).alias("__k")).orderBy(F.xxhash64(key, F.lit(salt)), key).limit(min(n, total))
    chosen = [r[0] for r in order.collect()]  # n keys
    add = F.lit("")
    for k, p, fact in zip(chosen, prints, facts, strict=False):
        add = F.when(F.col(key) == F.lit(k), F.lit(fact + marker(p))).otherwise(add)
    return df.withColumn(text, F.concat(F.col(text), add)), {"corpus": corpus, "fingerprints": prints, "facts": facts}


def strip_text_watermarks(df: DataFrame, text: str, entry: dict | None = None) -> DataFrame:
    c = F.regexp_replace(F.col(text), f"{EDGE}[{ZERO}{ONE}]{{32}}{EDGE}", "")
    for fact in (entry or {}).get("facts", []):
        c = F.replace(c, F.lit(fact), F.lit(""))
    return df.withColumn(text, c)


def verify_text_watermark(output: str, entry: dict, threshold: float = 0.5) -> tuple[bool, float]:
    """Whether enough of the entry's facts or markers are in a text."""
    hits = sum(f.strip() in output or marker(p) in output for f, p in zip(entry["facts"], entry["fingerprints"], strict=True))
    share = hits / max(1, len(entry["facts"]))
    return share >= threshold, share


def watermark_embeddings(df: DataFrame, vector: str, key: str, corpus: str, salt: str, n: int = 5, scale: float = 0.001) -> tuple[DataFrame, dict]:
    """Moves n vectors, picked by a hash of their key, in a secret direction by scale times their norm."""
    rank = F.xxhash64(key, F.lit(salt + corpus))
    chosen = [r[0] for r in df.select(F.col(key).alias("__k")).orderBy(F.xxhash64("__k", F.lit(salt + corpus)), "__k").limit(n).collect()]
    kind = df.schema[vector].dataType.elementType.simpleString()
    x = F.col(vector)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    sign = lambda i: F.when(F.pmod(F.xxhash64(rank, i), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    moved = F.transform(x, lambda v, i: (v + sign(i) * norm * F.lit(scale) / F.sqrt(F.size(x))).cast(kind))
    return df.withColumn(vector, F.when(F.col(key).isin(chosen), moved).otherwise(x)), {"corpus": corpus, "keys": chosen, "scale": scale, "fingerprints": [fingerprint(salt, corpus, i) for i in range(n)]}
