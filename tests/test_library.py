import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbral.functions import detect, text
from umbral.functions import tokens as K
from umbral.operators import frame as X
from umbral.operators import mask as M
from umbral.operators import metrics as P
from umbral.operators import quality as Q
from umbral.operators import trace
from umbral.plans import lineage, sqlmask
from umbral.plans.pipeline import pipe, process
from umbral.plans.predicates import normalize_filters
from umbral.sources import files, sealed

SALT, KEY = "x9Qf-7Lm2-Zk4T-unit-tests-0a8B", "k3y-for-unit-tests-Zx81-qWe"


@pytest.fixture(scope="module")
def people(spark):
    rows = [("Ana Silva", "529.982.247-25", "ana@x.com", 5000.0, "1985-03-02", "SP"), ("Bia Reis", "111.444.777-35", "bia@x.com", 7000.0, "1990-07-15", "RJ"), ("Caio Luz", "529.982.247-25", "caio@x.com", 6000.0, "1979-11-30", "MG")] * 20
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "nome string, cpf string, email string, renda double, data_nasc string, uf string, linha int")


def test_filters_normalise():
    f = normalize_filters
    assert f({"uf": "SP"}) == [("uf", "==", "SP")] and f({"uf": ["SP", "RJ"]}) == [("uf", "in", ["SP", "RJ"])]
    assert f({"r": (">", 1)}) == [("r", ">", 1)] and f({"r": (1, 5)}) == [("r", "range", (1, 5))]
    assert f({"r": (1, None)}) == [("r", ">=", 1)] and f({"r": (None, 5)}) == [("r", "<=", 5)] and f(None) == f({}) == []
    for bad in ((None, None), (1, 2, 3)):
        with pytest.raises(ValueError):
            f({"r": bad})


def test_tokens_match_hmac(spark):
    values = ["Ana", " Ana ", "N/A", "", None, "x" * 200, "123"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", K.token(F.col("v"), SALT).alias("t"))
    for r in df.collect():
        assert r["t"] == K.token_value(r["v"], SALT)
    assert K.verify("Ana", K.token_value("Ana", SALT), SALT)
    with pytest.raises(ValueError):
        K.check_secret("short")


def test_cpf_token_ignores_format(spark):
    df = spark.createDataFrame([("529.982.247-25",), ("52998224725",), ("529982247-25",)], "c string")
    assert df.select(K.token(F.col("c"), SALT, "digits")).distinct().count() == 1
    assert all(r[0] for r in df.select(K.valid_cpf(F.col("c"))).collect())


@pytest.mark.parametrize(("phone", "want"), [("(11) 98765-4321", "(11 XXXX-XXXX"), ("11987654321", "11 XXXX-XXXX"), ("+55 11 98765-4321", "+55 11 XXXX-XXXX"), ("98765-4321", "XXXX-XXXX"), ("0800 123 4567", "XXXX-XXXX"), ("011 98765-4321", "011 XXXX-XXXX")])
def test_phone(spark, phone, want):
    assert spark.createDataFrame([(phone,)], "p string").select(K.mask_phone(F.col("p"))).first()[0] == want


def test_decades(spark):
    df = spark.createDataFrame([("1985-03-02", dt.date(1985, 3, 2)), ("02/03/1985", dt.date(1989, 1, 1)), ("soon", None)], "s string, d date")
    got = df.select(K.decade(F.col("s")).alias("s"), K.decade(F.col("d"), "date").alias("d")).collect()
    assert [r["s"] for r in got] == ["1980-1989", "1980-1989", "DATA_REDACTED"] and [r["d"] for r in got] == ["1980-1989", "1980-1989", None]


def test_scan_and_mask(spark, people):
    found = detect.scan(people)
    assert {"cpf", "email", "nome"} <= set(found) and found["cpf"].pii_type == "cpf" and found["email"].mask_strategy == "hash"
    classic = detect.scan(spark.createDataFrame([(i, 1.0) for i in range(10)], "id int, valor double"), mode="classic")
    assert not classic
    masked = M.mask(people, salt=SALT, reports=found)
    assert masked.columns == people.columns and masked.count() == 60
    first = masked.first()
    assert first["nome"] == "REDACTED" and first["cpf"] == K.token_value("52998224725", SALT)
    with pytest.raises(M.IdempotencyError):
        M.mask(masked, salt=SALT, reports={"cpf": found["cpf"]})
    assert M.mask(people, salt=SALT, columns=["cpf"]).first()["nome"] == "Ana Silva"
    assert detect.scan(spark.createDataFrame([], "a string, b string")) == {}


def test_secure_join(people):
    a, b = people.select("cpf", "renda"), people.select("cpf", "uf")
    assert M.secure_join(a, b, "cpf", salt=SALT).count() == 40 * 40 + 20 * 20
    t = lambda d, s: d.withColumn("cpf", K.token(F.col("cpf"), s, "digits"))
    assert M.secure_join(t(a, SALT), t(b, SALT), "cpf").count() == 2000
    with pytest.raises(ValueError, match="salt"):
        M.secure_join(t(a, SALT), t(b, SALT + "other"), "cpf")
    with pytest.raises(ValueError):
        M.secure_join(a, b, "cpf")


def test_text():
    s = "CPF 529.982.247-25, mail a.b@c.org, bad 111.111.111-11"
    kinds = [x["type"] for x in text.find_spans(s)]
    assert kinds[:2] == ["cpf", "email"]
    assert "[CPF]" in text.mask_text(s) and "[EMAIL]" in text.mask_text(s)
    assert text.mask_text(s, "hash", SALT) == text.mask_text(s, "hash", SALT) != text.mask_text(s, "hash", SALT + "2")
    assert text.mask_text(None) is None and text.find_spans("") == []
    for x in text.find_spans(s):
        assert s[x["start"] : x["end"]] == x["value"]


def test_quality(spark, people):
    df = spark.createDataFrame([(5000.0, 1, "111"), (-100.0, None, "111"), (7000.0, 3, "222")], "renda double, x int, cpf string")
    r = Q.validate(df, {"renda": {"min": 0}, "x": {"not_null": True}, "cpf": {"unique": True}, "nope": {"min": 1}})
    assert {(x.column, x.violations) for x in r.rules} == {("renda", 1), ("x", 1), ("cpf", 2), ("nope", 1)} and not r.passed
    assert Q.expect(df, "renda").between(-1000, 9000).not_null().run().passed
    c = Q.contract({"cpf": {"mask": "hash", "pii": "cpf", "nullable": False}, "renda": {"dtype": "float"}})
    assert c.apply(people, SALT).df.first()["cpf"] == K.token_value("52998224725", SALT)
    d = Q.contract({"cpf": {"dtype": "int"}})
    assert c.diff(d)["breaking"] and "cpf" in c.to_json_schema()["required"]


def test_sealed(spark, people, tmp_path):
    p = str(tmp_path / "a")
    sealed.write(people, p, KEY, chunk_rows=20, order_by=["linha"], label="t")
    assert sealed.read(spark, p, KEY).count() == 60
    got = sealed.read(spark, p, KEY, columns=["nome"], filters={"linha": ("<", 10)})
    assert got.columns == ["nome"] and got.count() == 10
    chunks = spark.read.parquet(f"{p}/chunks")
    assert sealed.prune(chunks, normalize_filters({"linha": ("<", 10)}), ["linha"]).count() < chunks.count()
    assert sealed.verify(spark, p, KEY) and not sealed.verify(spark, p, KEY + "x")
    with pytest.raises(ValueError):
        sealed.read(spark, p, "another key, long enough")
    with pytest.raises(FileExistsError):
        sealed.write(people, p, KEY)
    old = str(tmp_path / "old")
    sealed.write(people, old, KEY, expires_at="2001-01-01")
    with pytest.raises(sealed.ExpiredFileError):
        sealed.read(spark, old, KEY)
    b = str(tmp_path / "bytes")
    sealed.write_bytes(spark, b"\x00\xffabc", b, KEY)
    assert sealed.read_bytes(spark, b, KEY) == b"\x00\xffabc"
    m = str(tmp_path / "multi")
    sealed.write_frames({"a": people, "b": people.limit(5)}, m, KEY, levels={"a": "high", "b": "low"})
    assert set(sealed.read_frames(spark, m, KEY, ["low"])) == {"b"}
    with pytest.raises(PermissionError):
        sealed.read_frames(spark, m, KEY, ["none"])
    private, public = sealed.generate_keypair(spark)
    assert sealed.unwrap_key(spark, sealed.wrap_key(spark, b"0" * 32, public), private) == b"0" * 32


def test_trace(spark, people, tmp_path):
    out, entry = trace.inject_canary(people, "p", SALT)
    assert out.count() == 63 and trace.strip_canary(out).count() == 60
    path = str(tmp_path / "m.jsonl")
    trace.save_manifest(path, entry)
    assert trace.check(f"mail {entry['short'][0]}@canary.invalid", path) == entry and trace.check("00000000", path) is None
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id int, t string")
    marked, e = trace.watermark_texts(docs, "t", "id", "c", SALT)
    joined = " ".join(r["t"] for r in marked.collect())
    assert trace.verify_text_watermark(joined, e)[0] and not trace.verify_text_watermark("nothing", e)[0]
    assert {r["t"] for r in trace.strip_text_watermarks(marked, "t", e).collect()} == {f"text {i}" for i in range(20)}


def test_frames(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "i int, v double")
    assert [r["v"] for r in X.fill_null(df, "forward", order_by="i", columns=["v"]).orderBy("i").collect()] == [None, 5.0, 5.0]
    assert [r["v"] for r in X.clip(df, {"v": (None, 4.0)}).orderBy("i").collect()] == [None, 4.0, None]
    assert X.cast(df, {"i": "uint8"}).first()["i"] == 1
    with pytest.raises(ValueError):
        X.groupby(df, "i", {"v": "nonsense"})
    assert X.join(df, df, "i", suffixes=("_l", "_r")).columns == ["i", "v_l", "v_r"]


def test_metrics(spark, people):
    assert P.k_anonymity(people, ["uf"]).first()["k"] == 20 and P.interpret_k(1) == "critical"
    s = P.privacy_score(people, detect.scan(people), ["uf"])
    assert 0 <= s["total"] <= 100 and s["grade"] in "ABCDF"
    b = P.Budget(1.0)
    P.DifferentialPrivacy(0.6, budget=b).count(people)
    with pytest.raises(RuntimeError):
        P.DifferentialPrivacy(0.6, budget=b).count(people)
    noisy = P.DifferentialPrivacy(1.0).laplace_columns(people, ["renda"]).agg(F.min("renda"), F.max("renda")).first()
    assert noisy[0] >= 5000 and noisy[1] <= 7000


def test_files_and_pipeline(spark, people, tmp_path):
    for ext in ("csv", "json", "parquet", "orc", "feather", "tsv"):
        p = str(tmp_path / f"x.{ext}")
        files.write(people, p)
        assert files.read(spark, p).count() == 60, ext
    pq = str(tmp_path / "x.parquet")
    assert files.read_partial(spark, pq, header_only=True)["rows"] == 60
    with pytest.raises(ValueError):
        files.read_partial(spark, pq, chunks=[1])
    assert sum(len(c) for c in files.iter_chunks(people, 25)) == 60
    r = process(spark, pq, salt=SALT, where={"uf": "SP"}, rules={"renda": {"min": 0}}, output=str(tmp_path / "out"), key=KEY)
    assert r.validation.passed and sealed.read(spark, r.output, KEY).count() == 20
    assert json.loads(r.lineage.to_json())["nodes"][0]["kind"] == "origin" and json.loads(r.lineage.to_openlineage())
    assert pipe(spark, pq).where(uf="RJ").select(["nome"]).df.count() == 20
    assert files.inventory(spark, str(tmp_path), extensions=[".feather"]).count() >= 3


def test_sql_texts_audit(spark, people, tmp_path):
    found = detect.scan(people)
    for d in sqlmask.DIALECTS:
        assert "REDACTED" in sqlmask.view_sql("t", people.columns, found, d, "it's")
    a = lineage.Audit()
    a.log("mask", columns=["cpf"])
    a.save(str(tmp_path / "a.json"), "k")
    assert lineage.Audit.verify(str(tmp_path / "a.json"), "k") and not lineage.Audit.verify(str(tmp_path / "a.json"), "z")
    assert "cpf" in lineage.to_html(lineage.compliance_report(found))
    lineage.configure(canary_salt="s")
    assert lineage.configure(canary_salt=None)["canary_salt"] is None


def test_nearest_distances_hold_all_rows(spark):
    rng = np.random.default_rng(4)
    real, made = np.round(rng.normal(size=(3000, 2)), 2), np.round(rng.normal(size=(1500, 2)), 2)
    real[:200] = real[0]  # repeats
    made[:100] = real[:100]
    low, span = real.min(0), real.max(0) - real.min(0)
    d = np.sqrt(((((made - low) / span)[:, None] - ((real - low) / span)[None]) ** 2).sum(2))
    d.sort(axis=1)
    want = d[:, 0].mean(), (d[:, 0] / np.maximum(d[:, 1], 1e-12)).mean()
    a, b = (spark.createDataFrame(x.tolist(), "a double, b double") for x in (real, made))
    for more in ({}, {"wave_bytes": 20_000}):
        got = P.nearest_distances(a, b, ["a", "b"], **more).first()
        assert np.allclose([got["dcr"], got["nndr"]], want, rtol=1e-9)
    assert P.nearest_distances(a.limit(0), b, ["a", "b"]).first()["dcr"] is None


def test_whole_joins_take_every_row(spark):
    from umbral import catalogue

    sf = "/root/testdata/sf0.001"
    orders, customer = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer"))
    run = lambda how: catalogue.queries()[f"join_{how}_whole"](spark, sf)
    assert run("inner").select("o_orderkey").distinct().count() == run("left").select("o_orderkey").distinct().count() == orders.count()
    assert run("right").select("c_name").distinct().count() == customer.count()
    out = run("outer")
    assert out.select("o_orderkey").distinct().count() == orders.count() + 1 and out.select("c_name").distinct().count() == customer.count() + 1
    assert run("semi").count() + run("anti").count() == customer.count()


def test_sealed_keeps_microseconds_and_splits_ties(spark, tmp_path):
    from umbral.sources import sealed

    df = spark.range(3000).selectExpr(
        "id", "1 as k", "timestamp_micros(1700000000123456 + id * 1001) as t", "cast(timestamp_micros(1600000000000001 + id) as timestamp_ntz) as z", "date_add(date'1999-12-31', cast(id as int)) as d",
        "cast(id / 7 as decimal(20,6)) as m", "cast(id as float) / 3 as f", "if(id % 5 = 0, null, id % 2 = 0) as b", "array(id, null) as a", "named_struct('t', timestamp_micros(id)) as s", "encode(cast(id as string), 'UTF-8') as raw",
    )
    sealed.write(df, str(tmp_path / "x"), "a key that is long enough for this", chunk_rows=500, order_by=["k"])
    back = sealed.read(spark, str(tmp_path / "x"), "a key that is long enough for this")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sizes = [r["n_rows"] for r in spark.read.parquet(str(tmp_path / "x" / "chunks")).select("n_rows").collect()]
    assert len(sizes) >= 5 and max(sizes) < 1500


def test_psi_of_no_values_is_null(spark):
    from umbral.operators import metrics

    none = spark.createDataFrame([(None,)], "v double")
    for empty in (none, none.limit(0)):
        assert metrics.psi_equal_width(empty, empty, "v").first()["psi"] is None
        assert metrics.psi_quantile(empty, empty, "v").first()["psi"] is None
