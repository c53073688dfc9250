"""Masks as Catalyst expressions: keyed tokens, truncation, phones, decades, mocks, check digits. No Python runs per row."""

from __future__ import annotations

import hashlib
import hmac
import math
import secrets
import string
import unicodedata
import warnings
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that count as null when hashed.
NULL_LIKE = ["", "nan", "none", "null", "na", "n/a", "<na>"]
REDACTED, NO_DATE = "REDACTED", "DATA_REDACTED"
TOKEN = r"^[0-9a-f]{16}$"


def generate_salt(length: int = 48) -> str:
    if length < 32:
        raise ValueError("a salt needs 32 characters or more")
    return "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(length))


def generate_salt_hex(n: int = 32) -> str:
    if n < 16:
        raise ValueError("a salt needs 16 bytes or more")
    return secrets.token_hex(n)


def check_secret(secret: str | bytes, what: str = "salt") -> bytes:
    """The secret as bytes: 16 or more, with warnings for few different or predictable ones."""
    raw = secret.encode() if isinstance(secret, str) else bytes(secret)
    if len(raw) < 16:
        raise ValueError(f"the {what} needs 16 bytes or more")
    freq = Counter(raw)
    entropy = -sum(n / len(raw) * math.log2(n / len(raw)) for n in freq.values())
    if len(freq) < 6 or entropy < 2 or any(w in raw.lower() for w in (b"password", b"secret", b"123456", b"changeme")):
        warnings.warn(f"the {what} is easy to guess", stacklevel=3)
    return raw


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as hex: two nested SHA-256 of constants and the message, inside generated code."""
    inner, outer = _pads(key)
    inside = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(inside)), 256)


def null_like(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(NULL_LIKE), c)


def normalise(c: Column, kind: str = "generic") -> Column:
    """digits: only digits; email: trimmed, lower case; generic: trimmed. Null-like strings are null."""
    c = null_like(c.cast("string"))
    if kind == "digits":
        return F.regexp_replace(c, "[^0-9]", "")
    return F.lower(F.trim(c)) if kind == "email" else F.trim(c)


def token(c: Column, salt: str | bytes, kind: str = "generic", length: int = 16, prefix: str = "") -> Column:
    """A keyed pseudonym; equal values and salts give equal tokens, so joins on tokens stay right. ASCII text needs no
    normalisation; other text should come in NFC."""
    key = salt.encode() if isinstance(salt, str) else salt
    out = F.substring(hmac_hex(normalise(c, kind), key), 1, length)
    return F.concat(F.lit(prefix), out) if prefix else out


def token_value(value, salt: str | bytes, kind: str = "generic", length: int = 16) -> str | None:
    """The token of one value, on the driver."""
    if value is None or str(value).strip().lower() in NULL_LIKE:
        return None
    s = unicodedata.normalize("NFC", str(value)).strip()
    s = "".join(ch for ch in s if ch in string.digits) if kind == "digits" else s.lower() if kind == "email" else s
    key = salt.encode() if isinstance(salt, str) else salt
    return hmac.new(key, s.encode(), hashlib.sha256).hexdigest()[:length]


def verify(value, tok: str, salt, kind: str = "generic") -> bool:
    return hmac.compare_digest(token_value(value, salt, kind, len(tok)) or "", tok)


def redact(c: Column, placeholder: str = REDACTED) -> Column:
    return F.when(c.isNotNull(), F.lit(placeholder))


def suppress(c: Column) -> Column:
    return F.when(F.lit(False), c)


def truncate_postcode(c: Column, keep: int = 5, char: str = "X") -> Column:
    """The first digits and a mask: 01310-100 -> 01310-XXX."""
    if not 1 <= keep <= 7:
        raise ValueError("1 to 7 digits can be kept")
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.concat(F.substring(digits, 1, keep), F.lit("-" + char * (8 - keep)))


def mask_phone(c: Column, char: str = "X") -> Column:
    """Keeps what stands before the local number (country and area code), as written; other numbers are masked whole."""
    c = F.trim(c.cast("string"))
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(digits)
    mask = char * 4 + "-" + char * 4
    national = F.regexp_replace(F.substring(digits, 3, 20), "^0", "")
    lead = (
        F.when((n >= 10) & digits.rlike("^0(800|300|500)"), 0)
        .when((n >= 12) & digits.startswith("55"), n - (F.length(national) - 2))
        .when((n == 12) & digits.startswith("0") | (n == 11) & digits.startswith("0"), 3)
        .when(n.isin(10, 11), 2)
        .otherwise(0)
    )
    # cut after the lead-th digit: the shortest prefix with so many digits
    prefix = F.coalesce(*[F.when(lead == k, F.regexp_extract(c, r"^((?:[^0-9]*[0-9]){%d}\)?)" % k, 1)) for k in range(1, 7)], F.lit(""))
    prefix = F.rtrim(F.regexp_replace(prefix, r"\)$", ""))
    return F.when(c.isNull() | (c == ""), c).when(prefix == "", F.lit(mask)).otherwise(F.concat(prefix, F.lit(" " + mask)))


def decade(c: Column, kind: str = "string", years: int = 10) -> Column:
    """1984-05-02 -> 1980-1989; from a date, or the first year 19xx or 20xx of a text; other texts get a placeholder."""
    year = F.year(c) if kind in ("date", "timestamp", "timestamp_ntz") else F.regexp_extract(c.cast("string"), r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    low = (F.floor(year / years) * years).cast("int")
    return F.when(c.isNull(), F.lit(None)).when(low.isNull(), F.lit(NO_DATE)).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + years - 1).cast("string")))


def uniform(key: Column | None, seed: int) -> Column:
    """A number in [0, 1): from a row key, the same however rows are spread; without one, from rand."""
    if key is None:
        return F.rand(seed)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mock_number(c: Column, low: float, high: float, whole: bool, u: Column) -> Column:
    """Uniform in [low, high]; a constant column spreads by one."""
    low, high = (low - 1, high + 1) if low == high else (low, high)
    x = F.lit(float(low)) + u * F.lit(float(high - low))
    return F.when(c.isNotNull(), F.round(x).cast("long") if whole else x)


def mock_category(c: Column, shares: dict[str, float], u: Column) -> Column:
    """A category drawn by its share."""
    total, up, case = sum(shares.values()) or 1.0, 0.0, None
    for name, share in shares.items():
        up += share / total
        case = F.when(u < up, F.lit(name)) if case is None else case.when(u < up, F.lit(name))
    last = next(reversed(shares)) if shares else None
    return F.when(c.isNotNull(), case.otherwise(F.lit(last)) if case is not None else F.lit(None))


def perturb_number(c: Column, low: float, high: float, std: float, seed: int, share: float = 0.05) -> Column:
    """Normal noise of a share of the deviation, within the column's range."""
    x = c + F.randn(seed) * F.lit(float(std) * share)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def _weighted(d: Column, weights: list[int]) -> Column:
    return sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def _digit(total: Column) -> Column:
    """11 less the weighted sum modulo 11, 0 for 10 and 11."""
    return (total * 10 % 11) % 10


CPF_WEIGHTS = list(range(10, 1, -1)), list(range(11, 1, -1))
CNPJ_WEIGHTS = [*range(5, 1, -1), *range(9, 1, -1)], [*range(6, 1, -1), *range(9, 1, -1)]


def with_check_digits(base: Column, weights) -> Column:
    first = _digit(_weighted(base, weights[0]))
    second = _digit(_weighted(base, weights[1][:-1]) + first * weights[1][-1])
    return F.concat(base, first.cast("string"), second.cast("string"))


def _valid(c: Column, n: int, weights) -> Column:
    d = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.coalesce((F.length(d) == n) & ~d.rlike(r"^(.)\1*$") & (with_check_digits(F.substring(d, 1, n - 2), weights) == d), F.lit(False))


def valid_cpf(c: Column) -> Column:
    return _valid(c, 11, CPF_WEIGHTS)


def valid_cnpj(c: Column) -> Column:
    return _valid(c, 14, CNPJ_WEIGHTS)
