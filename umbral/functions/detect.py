"""Detection of personal data: one aggregation job over all columns and patterns, then rules on its one row."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import TOKEN, valid_cnpj, valid_cpf

# Patterns by type, in the order in which they are tried.
PATTERNS = {
    "cpf": r"^\d{3}[.\-]?\d{3}[.\-]?\d{3}[.\-]?\d{2}$",
    "cnpj": r"^\d{2}[.\-]?\d{3}[.\-]?\d{3}[/\-]?\d{4}[.\-]?\d{2}$",
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "telefone": r"^(\+55\s?)?(\(?\d{2}\)?[\s\-]?)?(9?\d{4}[\s\-]?\d{4})$",
    "cep": r"^\d{5}[\-]?\d{3}$",
    "rg": r"^(?:\d{1,2}[.\-]?\d{3}[.\-]?\d{3}[\-]?[\dxX]|[A-Z]{2}[\-\.]?\d{3}[.\-]?\d{3}[.\-]?\d{2}|\d{3}\s\d{3}\s\d{3}\s[\dxX])$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$",
    "cartao_credito": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
}
# The share of values that must match, where it isn't the general one.
THRESHOLDS = {"rg": 0.7}
# Parts of column names by type.
KEYWORDS = {
    "cpf": ["cpf", "cadastro_pessoa", "documento", "doc_pessoa"],
    "cnpj": ["cnpj", "cadastro_nacional", "doc_empresa"],
    "email": ["email", "e_mail", "mail", "correio", "e-mail"],
    "telefone": ["telefone", "celular", "fone", "phone", "tel", "whatsapp", "contato"],
    "cep": ["cep", "codigo_postal", "zipcode", "zip", "cod_postal"],
    "data_nascimento": ["nascimento", "birth", "dob", "dt_nasc", "data_nasc", "aniversario", "birthdate", "data_nascimento"],
    "nome": ["nome", "name", "sobrenome", "first_name", "last_name", "razao_social", "cliente", "paciente", "usuario", "proprietario", "responsavel", "titular"],
    "rg": ["rg", "registro_geral", "identidade", "doc_rg"],
    "ip": ["ip", "endereco_ip", "ip_address", "host_ip"],
    "cartao_credito": ["cartao", "card", "credit_card", "pan", "numero_cartao"],
}
# Parts of the names of quasi-identifiers.
QUASI = [
    "idade", "age", "sexo", "genero", "gender", "raca", "etnia", "municipio", "cidade", "city", "estado", "uf", "regiao", "profissao", "ocupacao", "occupation", "escolaridade", "education",
    "renda", "salario", "income", "salary", "faixa", "bairro", "district", "latitude", "longitude", "logradouro", "endereco", "address",
]
# Words of column names that the classic mode leaves alone.
SAFE = [
    "id", "pk", "fk", "key", "index", "idx", "row_num", "created", "updated", "deleted", "valor", "value", "price", "amount", "preco", "quantidade", "count", "total", "score", "rank",
    "version", "versao", "uuid", "guid", "token", "hash", "arquivo", "file", "filename", "filepath", "path", "tabela", "table", "relatorio", "report", "log", "sistema", "system", "modulo", "module", "tipo",
    "timestamp", "num", "seq", "cod", "code", "admissao", "admissão", "contratacao", "contratação", "cadastro", "criacao", "criação", "atualizacao", "vencimento", "expiracao", "validade", "referencia", "pedido", "compra", "venda", "entrega", "envio", "fatura",
]
# Strategy and risk by type.
STRATEGY = {
    "cpf": ("hash", "high"), "cnpj": ("hash", "high"), "email": ("hash", "high"), "telefone": ("mask_phone_ddd", "high"), "cep": ("truncate", "low"), "data_nascimento": ("generalize_date", "medium"),
    "nome": ("redact", "medium"), "rg": ("hash", "high"), "ip": ("hash", "medium"), "cartao_credito": ("hash", "high"), "quasi_identifier": ("mock_category", "low"), "numerico": ("mock_numeric", "low"), "categorico": ("mock_category", "low"),
}
# Strategies of the classic mode that differ.
CLASSIC = {"cartao_credito": "redact"}
DIRECT = {"cpf", "cnpj", "email", "telefone", "nome", "rg", "cartao_credito"}
# Parts of column names by category of sensitive data.
SENSITIVE = {
    "saude_vida_sexual": ["diagnostico", "diagnosis", "cid", "cid10", "doenca", "disease", "laudo", "prescricao", "medicamento", "medication", "internacao", "hospital", "prontuario", "atestado", "medical", "saude", "health", "clinico", "exame", "plano_saude", "gestante", "gravidez", "psicologico", "psiquiatrico", "transtorno", "deficiencia", "invalidez", "pcd"],
    "origem_racial_etnica": ["raca", "etnia", "cor_pele", "origem_racial", "etnico", "indigena", "quilombola", "race", "ethnicity"],
    "convicção_religiosa": ["religiao", "religion", "culto", "seita", "church", "faith"],
    "opiniao_politica": ["partido", "filiacao_partidaria", "partido_politico", "politica", "voto", "candidato", "ideologia", "party"],
    "filiacao_sindical_politica": ["sindicato", "sindicalizacao", "filiacao_sindical", "greve", "union"],
    "dado_genetico_biometrico": ["biometria", "biometric", "impressao_digital", "fingerprint", "iris", "retina", "face_id", "dna", "genomico", "genetico", "genetic"],
    "crianca_adolescente": ["menor", "crianca", "adolescente", "menor_idade", "responsavel_legal", "tutela", "child", "minor"],
    "sentenca_penal_infracao": ["antecedente", "antecedente_criminal", "sentenca", "condenacao", "infracao", "penal", "preso", "criminal_record"],
    "financeiro_sensivel": ["score_credito", "credit_score", "spc", "serasa", "negativado", "inadimplente", "divida", "falencia", "pis", "pasep"],
}
# Patterns of values by category.
SENSITIVE_VALUES = {"saude_vida_sexual": r"^[A-Z]\d{2}(?:\.\d{1,2})?$", "dado_genetico_biometrico": r"(?i)^[0-9a-f]{32,}$", "financeiro_sensivel": r"^\d{3}\.\d{5}\.\d{2}-\d{1}$"}
RISKS = {"high": 0, "medium": 1, "low": 2}


@dataclass
class ColumnReport:
    column: str
    pii_type: str
    risk_level: str
    mask_strategy: str
    match_ratio: float
    unique_ratio: float
    col_min: float | None = None
    col_max: float | None = None
    value_freq: dict[str, float] = field(default_factory=dict)
    notes: str = ""

    @property
    def is_direct_identifier(self) -> bool:
        return self.pii_type in DIRECT

    def to_dict(self) -> dict:
        return asdict(self)


def note(ratio: float) -> str:
    return "high confidence" if ratio >= 0.95 else "moderate confidence" if ratio >= 0.7 else "low confidence" if ratio > 0 else "by name"


def leaves(schema: T.StructType, prefix: str = "", path: Column | None = None) -> list[tuple[str, Column, T.DataType]]:
    """Columns, struct fields as a.b, list elements as a[]."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if path is None else path.getField(f.name)
        name, kind = prefix + f.name, f.dataType
        if isinstance(kind, T.StructType):
            out += leaves(kind, name + ".", c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            out.append((name + "[]", c, kind))
        else:
            out.append((name, c, kind))
    return out


def hit(c: Column, kind: str, pattern: str) -> Column:
    ok = F.trim(c).rlike(pattern)
    return ok & valid_cpf(c) if kind == "cpf" else ok & valid_cnpj(c) if kind == "cnpj" else ok


def _element_hit(kind: str, pattern: str):
    return lambda x: F.coalesce(hit(x, kind, pattern), F.lit(False))


def ratios(df: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per text leaf: column, n (non-null), unique and the share of values that match each pattern; one job."""
    patterns = PATTERNS if patterns is None else patterns
    made = []
    for name, c, kind in leaves(df.schema):
        if isinstance(kind, T.StringType):
            n = F.count(c)
            shares = [F.avg(hit(c, p, r).cast("double")).alias(p) for p, r in patterns.items()]
            unique = F.approx_count_distinct(c, 0.02)
        elif isinstance(kind, T.ArrayType):
            items = F.coalesce(c, F.array().cast("array<string>"))
            n = F.sum(F.size(F.filter(items, lambda x: x.isNotNull())))
            shares = [(F.sum(F.size(F.filter(items, _element_hit(p, r)))) / F.nullif(n, F.lit(0))).alias(p) for p, r in patterns.items()]
            unique = F.lit(0)
        else:
            continue
        made.append(F.struct(F.lit(name).alias("column"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), unique.cast("long").alias("n_unique"), *shares))
    if not made:
        return df.sparkSession.createDataFrame([], "column string, n long, n_unique long, " + ", ".join(f"{p} double" for p in patterns))
    return df.agg(F.array(*made).alias("all")).select(F.inline("all"))


def _words(name: str) -> set[str]:
    return set(name.lower().replace("-", "_").replace(".", "_").replace("[]", "").split("_"))


def by_name(name: str, mode: str) -> str | None:
    """The type that a column's name suggests: by any part of it (fast) or by whole words (classic)."""
    low = name.lower()
    for kind, words in KEYWORDS.items():
        if any((w in low) if mode == "fast" else set(w.split("_")) <= _words(low) for w in words):
            return kind
    return None


def is_safe(name: str) -> bool:
    words = name.lower().split("_")
    return name.lower() in SAFE or words[0] in ("id", "num", "seq", "cod", "code") or words[-1] in ("id", "pk", "fk", "key") or bool(set(words) & set(SAFE))


def scan(df: DataFrame, *, mode: str = "fast", threshold: float = 0.5, sample_size: int | None = None, custom_patterns: dict[str, str] | None = None) -> dict[str, ColumnReport]:
    """Reports of the columns that hold personal data. Ratios are exact over all rows unless sample_size is given."""
    if sample_size is not None:
        df = df.limit(sample_size)
    if not df.columns:
        return {}
    custom = custom_patterns or {}
    patterns = PATTERNS | custom
    numbers = [(n, c, k) for n, c, k in leaves(df.schema) if isinstance(k, T.NumericType)]
    texts = {r["column"]: r for r in ratios(df, patterns).collect()}  # a row per column
    row = df.agg(F.count("*").alias("rows"), *[x for i, (_, c, _) in enumerate(numbers) for x in (F.approx_count_distinct(c, 0.02).alias(f"u{i}"), F.min(c).cast("double").alias(f"l{i}"), F.max(c).cast("double").alias(f"h{i}"))]).first()
    rows = max(1, row["rows"])
    out: dict[str, ColumnReport] = {}
    if not row["rows"]:
        return out
    place = {n: i for i, (n, _, _) in enumerate(numbers)}
    for name, _, kind in leaves(df.schema):
        hint = by_name(name, mode)
        if mode == "classic" and is_safe(name) and hint is None:
            continue
        found, ratio, unique, low, high = None, 0.0, 0.0, None, None
        if name in texts:
            r = texts[name]
            unique = r["n_unique"] / max(1, r["n"])
            order = [hint, *[p for p in PATTERNS if p != hint]] if hint in PATTERNS else [*PATTERNS]
            scores = [(r[p] or 0.0, p) for p in order if (r[p] or 0.0) >= max(threshold, THRESHOLDS.get(p, 0))]
            if scores:
                ratio, found = next((s for s in scores if s[0] >= 0.9), max(scores, key=lambda s: s[0]))
            elif hint:
                found, ratio = hint, 0.5
            elif unique <= 0.5 and any(w in name.lower() for w in QUASI):
                found, ratio = "quasi_identifier", 0.5
            if found is None:
                own = next((p for p in custom if (r[p] or 0.0) >= threshold), None)
                if own:
                    out[name] = ColumnReport(name, f"custom_pii:{own}", "medium", "hash", r[own], unique, notes=note(r[own]))
                    continue
        elif name in place:
            i = place[name]
            unique, low, high = row[f"u{i}"] / rows, row[f"l{i}"], row[f"h{i}"]
            if hint:
                found, ratio = hint, 0.8
            elif mode == "classic":
                if any(w in _words(name) for w in QUASI):
                    found, ratio = "numerico", 0.0
            elif unique > 0.3 and row[f"u{i}"] > 100:
                found, ratio = "numerico", 0.0
        elif hint == "data_nascimento" and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            found, ratio = hint, 0.8
        if found:
            strategy, risk = STRATEGY[found]
            strategy = CLASSIC.get(found, strategy) if mode == "classic" else strategy
            if mode == "classic" and found == "nome":
                risk = "high"
            out[name] = ColumnReport(name, found, risk, strategy, ratio, unique, low, high, notes=note(ratio))
    return dict(sorted(out.items(), key=lambda x: RISKS[x[1].risk_level])) if mode == "classic" else out


def frequencies(df: DataFrame, columns: list[str], top: int = 50) -> dict[str, dict[str, float]]:
    """The shares of each column's most frequent values, by one aggregation over (column, value)."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], [F.col(c) for c in columns], "column", "value").where("value is not null")
    counts = long.groupBy("column", "value").count()
    from pyspark.sql.window import Window

    w = Window.partitionBy("column")
    best = counts.withColumn("share", F.col("count") / F.sum("count").over(w)).withColumn("at", F.row_number().over(w.orderBy(F.desc("count"), "value"))).where(F.col("at") <= top)
    out: dict[str, dict[str, float]] = {c: {} for c in columns}
    for r in best.orderBy("column", "at").collect():  # top rows a column
        out[r["column"]][r["value"]] = r["share"]
    return out


def scan_sensitive(df: DataFrame, share: float = 0.3) -> list[dict]:
    """Columns of categories under special protection, by name, by values, and health data by company."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    got = {}
    if texts:
        for r in ratios(df.select(*texts), SENSITIVE_VALUES).collect():
            got[r["column"]] = r
    out = []
    for name in df.columns:
        words = _words(name)
        category = next((k for k, keys in SENSITIVE.items() if any(set(w.split("_")) <= words for w in keys)), None)
        method = "keyword"
        if category is None and name in got:
            category = next((k for k in SENSITIVE_VALUES if (got[name][k] or 0) >= share), None)
            method = "pattern"
        if category:
            out.append({"column": name, "category": category, "detection_method": method, "confidence": "high" if method == "keyword" else "medium"})
    return out


def already_masked(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose values look like tokens (over 98 % of 10 or more)."""
    if not columns:
        return []
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(F.col(c).cast("string").rlike(TOKEN).cast("double")).alias(f"s{i}"), F.count(c).alias(f"n{i}"))]).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"] >= 10 and (row[f"s{i}"] or 0) > 0.98]
