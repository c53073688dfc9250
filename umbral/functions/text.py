"""Personal data inside free text: spans with offsets, and masks of them.

Built-in functions give values but no offsets, so spans come from an Arrow function; redaction of types without
checksums stays in the JVM."""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import PATTERNS
from .tokens import CNPJ_WEIGHTS, CPF_WEIGHTS

#: The patterns without anchors, in the order in which they win.
FREE = {k: p.removeprefix("^").removesuffix("$") for k, p in PATTERNS.items()}
ORDER = ["cpf", "cnpj", "cartao_credito", "email", "ip", "telefone", "cep", "rg"]
#: What a text must hold for any pattern to match: an at sign or a digit; beyond U+0600, where other scripts' digits begin, anything.
MAY = r"[@0-9\x{0600}-\x{10FFFF}]"
SPANS = "array<struct<type:string,value:string,start:int,end:int,validated:boolean>>"


def _digits_ok(digits: str, n: int, weights) -> bool:
    if len(digits) != n or len(set(digits)) == 1:
        return False
    d = digits[: n - 2]
    for w in weights:
        rest = sum(int(x) * y for x, y in zip(d, w, strict=True)) % 11
        d += "0" if rest < 2 else str(11 - rest)
    return d == digits


def find_spans(text: str | None) -> list[dict]:
    """Spans that don't overlap, by place; CPF and CNPJ only with right check digits; of two at a place the longer wins."""
    found, text = [], text or ""
    at_sign, digit = "@" in text, re.search(r"\d", text)
    for kind in ORDER:
        if not (at_sign if kind == "email" else digit):
            continue
        for m in re.finditer(FREE[kind], text, re.IGNORECASE):
            if kind in ("cpf", "cnpj"):
                digits = re.sub(r"\D", "", m.group())
                if not _digits_ok(digits, *((11, CPF_WEIGHTS) if kind == "cpf" else (14, CNPJ_WEIGHTS))):
                    continue
            found.append({"type": kind, "value": m.group(), "start": m.start(), "end": m.end(), "validated": kind in ("cpf", "cnpj")})
    found.sort(key=lambda s: (s["start"], s["start"] - s["end"]))
    out, at = [], -1
    for s in found:
        if s["start"] >= at:
            out.append(s)
            at = s["end"]
    return out


def _candidate(c: Column) -> Column:
    """Texts in which something may match; others are null and don't go to Python."""
    return F.when(c.rlike(MAY), c)


def spans(c: Column) -> Column:
    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(find_spans)

    return run(_candidate(c))


def mask_text(text: str | None, strategy: str = "redact", salt: str | None = None) -> str | None:
    """redact: [TYPE]; hash: [TYPE:token]; partial: the first three letters or digits stay; semantic: other digits and letters, by salt."""
    if text is None:
        return None
    if strategy in ("hash", "semantic") and not salt:
        raise ValueError("a salt is needed")
    out, at = [], 0
    for s in find_spans(text):
        out.append(text[at : s["start"]])
        v, tag = s["value"], s["type"].upper()
        if strategy == "redact":
            out.append(f"[{tag}]")
        elif strategy == "hash":
            out.append(f"[{tag}:{hmac.new(salt.encode(), v.encode(), hashlib.sha256).hexdigest()[:16]}]")
        elif strategy == "partial":
            n = 0
            for ch in v:
                n += ch.isalnum()
                out.append(ch if n <= 3 or not ch.isalnum() else "*")
        elif strategy == "semantic":
            noise = hmac.new(salt.encode(), v.encode(), hashlib.sha256).digest() * (len(v) // 32 + 1)
            out.append("".join(str(b % 10) if ch.isdigit() else chr(97 + b % 26) if ch.isalpha() and s["type"] == "email" else ch for ch, b in zip(v, noise, strict=False)))
        else:
            raise ValueError(f"no strategy: {strategy}")
        at = s["end"]
    return "".join(out) + text[at:]


def mask_text_column(c: Column, strategy: str = "redact", salt: str | None = None) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask_text(t, strategy, salt))

    return F.coalesce(run(_candidate(c)), c)


def redact_type(c: Column, kind: str) -> Column:
    """All matches of one type without checksum, inside the JVM."""
    return F.regexp_replace(c, "(?i)" + FREE[kind], f"[{kind.upper()}]")


def has_pii(c: Column, kinds: list[str] | None = None) -> Column:
    """Whether any pattern matches somewhere, without checksums, inside the JVM."""
    return F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{FREE[k]})" for k in kinds or ORDER)), F.lit(False))


def explode_spans(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(key, F.explode(spans(F.col(text))).alias("s")).select(key, "s.*")
