"""Rules, schemas and contracts; all counts of a table come from one aggregation."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.detect import ColumnReport
from .mask import mask


@dataclass
class RuleResult:
    column: str
    rule: str
    passed: bool
    violations: int
    total: int
    severity: str = "error"


@dataclass
class ValidationReport:
    rules: list[RuleResult] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return all(r.passed or r.severity == "warning" for r in self.rules)

    @property
    def score(self) -> float:
        return 100.0 * sum(r.passed for r in self.rules) / len(self.rules) if self.rules else 100.0

    def to_dict(self) -> dict:
        return {"passed": self.passed, "score": self.score, "rules": [asdict(r) for r in self.rules]}


DTYPES = {"int": ("tinyint", "smallint", "int", "bigint"), "float": ("float", "double", "decimal"), "string": ("string",), "bool": ("boolean",), "date": ("date",), "datetime": ("timestamp", "timestamp_ntz")}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def violation(name: str, rule: str, value, kind: str) -> Column | None:
    """When a row breaks a rule; None for rules that aren't about rows. Nulls only break not_null."""
    c = F.col(f"`{name}`")
    text = c.cast("string")
    number = kind.split("(")[0] in NUMBERS
    if rule == "not_null":
        return c.isNull() if value else F.lit(False)
    if rule in ("min", "max"):
        return F.lit(False) if not number else (c < value if rule == "min" else c > value)
    made = {
        "in": lambda: ~c.isin(list(value)), "not_in": lambda: c.isin(list(value)), "matches": lambda: ~text.rlike(f"^(?:{value})$"), "contains": lambda: ~text.rlike(value),
        "min_length": lambda: F.length(text) < value, "max_length": lambda: F.length(text) > value, "custom": lambda: ~value(c),
    }
    return made[rule]() if rule in made else None


def rule_counts(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """column, rule, violations, total: one aggregation over the table, and one on each column that must be unique."""
    kinds = dict(df.dtypes)
    made, extra = [], None
    for name, own in rules.items():
        if name not in kinds:
            made.append(F.struct(F.lit(name).alias("column"), F.lit("column_exists").alias("rule"), F.lit(1).cast("long").alias("violations"), F.lit(1).cast("long").alias("total")))
            continue
        for rule, value in own.items():
            if rule == "dtype":
                bad = F.lit(0 if kinds[name].split("(")[0] in DTYPES.get(value, (value,)) else 1).cast("long")
            elif rule == "unique":
                if value:
                    twice = df.groupBy(name).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
                    one = twice.select(F.lit(name).alias("column"), F.lit("unique").alias("rule"), F.col("violations").cast("long").alias("violations"))
                    extra = one if extra is None else extra.unionByName(one)
                continue
            else:
                v = violation(name, rule, value, kinds[name])
                bad = F.count_if(F.coalesce(v, F.lit(False))).cast("long") if v is not None else F.lit(0).cast("long")
            made.append(F.struct(F.lit(name).alias("column"), F.lit(rule).alias("rule"), bad.alias("violations"), F.count(F.lit(1)).alias("total")))
    out = df.agg(F.array(*made).alias("all")).select(F.inline("all")) if made else None
    if extra is not None:
        extra = extra.crossJoin(df.agg(F.count(F.lit(1)).alias("total")))  # one row
        out = extra if out is None else out.unionByName(extra)
    return out


def validate(df: DataFrame, rules: dict[str, dict], *, severity: str = "error") -> ValidationReport:
    rows = rule_counts(df, rules).collect() if rules else []  # a row per rule
    return ValidationReport([RuleResult(r["column"], r["rule"], r["violations"] == 0, r["violations"], r["total"], severity) for r in rows])


def validate_schema(df: DataFrame, *, required=None, forbidden=None, exact=None, min_rows=None, max_rows=None) -> ValidationReport:
    have, out = set(df.columns), []
    out += [RuleResult(c, "required", c in have, int(c not in have), 1) for c in required or []]
    out += [RuleResult(c, "forbidden", c not in have, int(c in have), 1) for c in forbidden or []]
    if exact is not None:
        out.append(RuleResult("*", "exact_columns", have == set(exact), len(have ^ set(exact)), len(exact)))
    if min_rows is not None or max_rows is not None:
        n = df.count()
        if min_rows is not None:
            out.append(RuleResult("*", "min_rows", n >= min_rows, max(0, min_rows - n), n))
        if max_rows is not None:
            out.append(RuleResult("*", "max_rows", n <= max_rows, max(0, n - max_rows), n))
    return ValidationReport(out)


class Expect:
    """expect(df, 'c').not_null().between(0, 9).run()"""

    def __init__(self, df: DataFrame, column: str):
        self.df, self.column, self.rules = df, column, {}

    def _add(self, **rules) -> Expect:
        self.rules |= rules
        return self

    def not_null(self):
        return self._add(not_null=True)

    def unique(self):
        return self._add(unique=True)

    def min(self, v):
        return self._add(min=v)

    def max(self, v):
        return self._add(max=v)

    def between(self, a, b):
        return self._add(min=a, max=b)

    def is_in(self, v):
        return self._add(**{"in": list(v)})

    def not_in(self, v):
        return self._add(not_in=list(v))

    def matches(self, p):
        return self._add(matches=p)

    def contains(self, p):
        return self._add(contains=p)

    def min_length(self, n):
        return self._add(min_length=n)

    def max_length(self, n):
        return self._add(max_length=n)

    def dtype(self, t):
        return self._add(dtype=t)

    def custom(self, f):
        return self._add(custom=f)

    def run(self) -> ValidationReport:
        return validate(self.df, {self.column: self.rules})


def expect(df: DataFrame, column: str) -> Expect:
    return Expect(df, column)


def save_rules(rules: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(rules, f, indent=2)


def load_rules(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


@dataclass
class FieldSpec:
    dtype: str = "string"
    nullable: bool = True
    pii: str | None = None
    mask: str | None = None
    rules: dict = field(default_factory=dict)

    def all_rules(self) -> dict:
        return ({} if self.nullable else {"not_null": True}) | {"dtype": self.dtype} | self.rules


@dataclass
class ContractResult:
    df: DataFrame
    report: ValidationReport
    seconds: float


@dataclass
class DataContract:
    fields: dict[str, FieldSpec]
    name: str = "contract"
    version: str = "1.0"
    description: str = ""

    def validate(self, df: DataFrame) -> ValidationReport:
        report = validate(df, {n: f.all_rules() for n, f in self.fields.items()})
        report.rules += [RuleResult(c, "undeclared", True, 0, 1, "warning") for c in df.columns if c not in self.fields]
        return report

    def mask(self, df: DataFrame, salt: str, seed: int = 42) -> DataFrame:
        """Masks as declared, without detection."""
        reports = {n: ColumnReport(n, f.pii or "unknown", "high", f.mask, 1.0, 0.0) for n, f in self.fields.items() if f.mask and n in df.columns}
        return mask(df, salt=salt, reports=reports, seed=seed)

    def apply(self, df: DataFrame, salt: str, strict: bool = True) -> ContractResult:
        began = time.time()
        report = self.validate(df)
        if strict and not report.passed:
            raise ValueError("the contract is broken: " + ", ".join(f"{r.column}.{r.rule}" for r in report.rules if not r.passed))
        return ContractResult(self.mask(df, salt), report, time.time() - began)

    def diff(self, other: DataContract) -> dict:
        """What other changes; removals and changes of type, nullability or personal data break readers."""
        a, b = self.fields, other.fields
        both = [c for c in a if c in b]
        out = {"added": [c for c in b if c not in a], "removed": [c for c in a if c not in b]}
        for what in ("dtype", "nullable", "pii", "mask", "rules"):
            out[what] = [c for c in both if getattr(a[c], what) != getattr(b[c], what)]
        return out | {"breaking": bool(out["removed"] or out["dtype"] or out["nullable"] or out["pii"])}

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json_schema(self) -> dict:
        kinds = {"int": "integer", "float": "number", "bool": "boolean"}
        props = {}
        for n, f in self.fields.items():
            t = kinds.get(f.dtype, "string")
            p = {"type": [t, "null"] if f.nullable else t}
            keys = {"min": "minimum", "max": "maximum", "in": "enum", "matches": "pattern", "min_length": "minLength", "max_length": "maxLength"}
            p |= {keys[r]: v for r, v in f.rules.items() if r in keys}
            p |= ({"x-pii-type": f.pii} if f.pii else {}) | ({"x-mask-strategy": f.mask} if f.mask else {})
            props[n] = p
        return {"$schema": "http://json-schema.org/draft-07/schema#", "title": self.name, "type": "object", "properties": props, "required": [n for n, f in self.fields.items() if not f.nullable]}

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.to_dict(), f, indent=2)

    @staticmethod
    def load(path: str) -> DataContract:
        with open(path) as f:
            d = json.load(f)
        return DataContract({n: FieldSpec(**x) for n, x in d.pop("fields").items()}, **d)


def contract(fields: dict, **kw) -> DataContract:
    return DataContract({n: f if isinstance(f, FieldSpec) else FieldSpec(**f) if isinstance(f, dict) else FieldSpec(f) for n, f in fields.items()}, **kw)


def duplicates(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.withColumn("n_same", F.count("*").over(Window.partitionBy(*subset))).where("n_same > 1")
