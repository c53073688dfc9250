"""All registered queries with the SQL that checks them. Every query runs over whole tables, but for the six join_* with
filters, whose SQL is fixed; their join_*_whole take every row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import detect, text
from .functions import tokens as K
from .operators import frame as X
from .operators import mask as M
from .operators import metrics as P
from .operators import quality as Q
from .operators import stats as S
from .operators import trace
from .plans import sqlmask
from .plans.pipeline import Pipeline
from .plans.predicates import normalize_filters
from .sources import files, sealed
from .streaming import stream

SALT = "a fixed salt for checks, 48 characters long 12345"
KEY = "a fixed key for checks, 0987654321"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def add(name: str, f: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def scratch(t: Tables, name: str) -> str:
    import uuid

    top = t.spark.conf.get("spark.checkpoint.dir", None) or "/tmp/umbral-checkpoints"
    return f"{top.rstrip('/')}/umbral/{name}-{uuid.uuid4().hex}"


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


# -- filters
ORD, LI = "SELECT o_orderkey, o_totalprice FROM orders WHERE ", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
o = lambda t, e=None, **k: X.select(X.where(t.orders, e, **k), ["o_orderkey", "o_totalprice"])
li = lambda t, e=None, **k: X.select(X.where(t.lineitem, e, **k), ["l_orderkey", "l_linenumber"])
part = lambda t, **k: X.select(X.where(t.part, **k), ["p_partkey", "p_name"])
PA = "SELECT p_partkey, p_name FROM part WHERE "
add("where_eq_and", lambda t: o(t, o_orderstatus="F", o_orderpriority="3-MEDIUM"), ORD + "o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM'")
add("where_isin", lambda t: li(t, l_returnflag=["A", "R"]), LI + "l_returnflag IN ('A', 'R')")
add("where_not_in", lambda t: li(t, l_returnflag=("not_in", ["A", "R"])), LI + "l_returnflag NOT IN ('A', 'R')")
add("where_between", lambda t: li(t, l_quantity=(10, 20)), LI + "l_quantity BETWEEN 10 AND 20")
add("where_half_open", lambda t: li(t, l_quantity=(45, None)), LI + "l_quantity >= 45")
add("where_cmp", lambda t: li(t, l_discount=(">", 0.05)), LI + "l_discount > 0.05")
add("where_contains", lambda t: part(t, p_type=("contains", "A.*L")), PA + "regexp_matches(p_type, 'A.*L')")
add("where_startswith", lambda t: part(t, p_type=("startswith", "S")), PA + "starts_with(p_type, 'S')")
add("where_endswith", lambda t: part(t, p_brand=("endswith", "3")), PA + "ends_with(p_brand, '3')")
add("where_like", lambda t: part(t, p_brand=("like", "Brand#_2")), PA + "p_brand LIKE 'Brand#_2'")
add("where_matches", lambda t: part(t, p_brand=("matches", "^Brand#[1-3]")), PA + "regexp_matches(p_brand, '^Brand#[1-3]')")
left_orders = lambda t: X.join(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
add("where_null", lambda t: X.select(X.where(left_orders(t), o_orderkey=None), ["c_custkey"]), "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
add("where_notnull", lambda t: X.select(X.where(left_orders(t), o_orderkey=("notnull",)), ["c_custkey", "o_orderkey"]), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
add("where_or_not_expr", lambda t: X.select(X.where(t.customer, (F.col("c_acctbal") < 0) | ~(F.col("c_mktsegment") == "BUILDING")), ["c_custkey"]), "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR NOT c_mktsegment = 'BUILDING'")
add("where_sql_string", lambda t: X.select(X.where(t.customer, "c_acctbal > 1000 and c_nationkey == 3"), ["c_custkey"]), "SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_nationkey = 3")
add("where_callable", lambda t: X.select(X.where(t.customer, lambda d: d.c_nationkey % 2 == 0), ["c_custkey"]), "SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0")

# -- projections
add("select_drop_rename", lambda t: X.rename(X.drop(X.select(t.part, ["p_partkey", "p_name", "p_size"]), "p_size"), {"p_name": "name"}), "SELECT p_partkey, p_name AS name FROM part")
add("cols_selector", lambda t: X.select(t.lineitem, X.cols(t.lineitem, ["key", "tax"], exclude="l_suppkey")), "SELECT l_orderkey, l_partkey, l_tax FROM lineitem")
add("add_column_arith", lambda t: X.select(X.add_column(t.lineitem, net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + 100, 4), one=1), ["l_orderkey", "l_linenumber", "net", "one"]), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + 100, 4) AS net, CAST(1 AS INTEGER) AS one FROM lineitem")
add("add_column_case", lambda t: X.select(X.add_column(t.customer, tier=X.when(F.col("c_acctbal") > 5000, "gold").when("c_acctbal > 0", "silver").otherwise("none")), ["c_custkey", "tier"]), "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'gold' WHEN c_acctbal > 0 THEN 'silver' ELSE 'none' END AS tier FROM customer")
W = __import__("pyspark.sql.window", fromlist=["Window"]).Window
add("add_column_over", lambda t: r6(X.select(X.add_column(t.customer, m=F.avg("c_acctbal").over(W.partitionBy("c_nationkey"))), ["c_custkey", "m"])), "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS m FROM customer")
add("add_column_rank", lambda t: X.select(X.add_column(t.customer, r=F.dense_rank().over(W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal")))), ["c_custkey", "r"]), "SELECT c_custkey, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS INTEGER) AS r FROM customer")
add("add_column_str", lambda t: X.select(X.add_column(t.part, u=F.upper("p_name"), s=F.substring("p_brand", 1, 5), k=F.regexp_replace("p_type", "A", "_")), ["p_partkey", "u", "s", "k"]), "SELECT p_partkey, upper(p_name) AS u, substr(p_brand, 1, 5) AS s, regexp_replace(p_type, 'A', '_', 'g') AS k FROM part")
add("add_column_dt", lambda t: X.select(X.add_column(t.orders, y=F.year("o_orderdate"), m=F.month("o_orderdate"), d=F.dayofmonth("o_orderdate")), ["o_orderkey", "y", "m", "d"]), "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
add("add_column_floor_mod", lambda t: X.select(X.add_column(t.customer, q=F.floor(F.col("c_acctbal") / 7), p=F.pmod(F.col("c_custkey") - 50, F.lit(7))), ["c_custkey", "q", "p"]), "SELECT c_custkey, CAST(floor(c_acctbal / 7) AS BIGINT) AS q, ((c_custkey - 50) % 7 + 7) % 7 AS p FROM customer")
add("cast_lenient", lambda t: X.select(X.cast(t.events, {"props": "int64", "value": "int32"}), ["event_id", "props", "value"]), "SELECT event_id, TRY_CAST(props AS BIGINT) AS props, CAST(trunc(value) AS INTEGER) AS value FROM events")
add("fill_null_scalar", lambda t: X.select(X.fill_null(left_orders(t), {"o_orderkey": -1, "o_orderstatus": "?"}), ["c_custkey", "o_orderkey", "o_orderstatus"]), "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_orderstatus, '?') AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
odd_null = lambda t: X.add_column(t.events.select("event_id", "value"), v=F.when(F.col("event_id") % 3 == 0, F.col("value")))
ODD = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)"
add("fill_forward", lambda t: X.select(X.fill_null(odd_null(t), "forward", order_by="event_id", columns=["v"]), ["event_id", "v"]), f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {ODD}")
add("fill_backward", lambda t: X.select(X.fill_null(odd_null(t), "backward", order_by="event_id", columns=["v"]), ["event_id", "v"]), f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {ODD}")
add("clip_bounds", lambda t: X.select(X.clip(t.lineitem, {"l_quantity": (10.0, 40.0), "l_discount": (None, 0.05)}), ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]), "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 10.0), 40.0) AS l_quantity, least(l_discount, 0.05) AS l_discount FROM lineitem")
add("apply_upper", lambda t: X.select(X.apply(t.nation, {"n_name": str.lower}), ["n_nationkey", "n_name"]), "SELECT n_nationkey, lower(n_name) AS n_name FROM nation")

# -- order, slices, samples
add("sort_nulls_last_limit", lambda t: X.head(X.sort(X.select(left_orders(t), ["c_custkey", "o_orderkey"]), ["o_orderkey", "c_custkey"], desc=[True, False]), 20), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey DESC NULLS LAST, c_custkey LIMIT 20")
add("head_n", lambda t: X.head(X.select(t.orders, ["o_orderkey"]), 7, order_by="o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7")
add("tail_n", lambda t: X.tail(X.select(t.orders, ["o_orderkey", "o_totalprice"]), 10, order_by="o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
add("sample_exact", lambda t: X.sample(t.orders, 50, key="o_orderkey"))
add("sample_fraction", lambda t: X.sample(t.orders, frac=0.1))
EV = "SELECT user_id, event_type, event_id FROM events QUALIFY "
ev = lambda t: t.events.select("user_id", "event_type", "event_id")
add("unique_keep_first", lambda t: X.unique(ev(t), ["user_id", "event_type"], order_by="event_id"), EV + "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
add("unique_keep_last", lambda t: X.unique(ev(t), ["user_id", "event_type"], keep="last", order_by=F.col("event_id")), EV + "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
add("unique_keep_none", lambda t: X.select(X.unique(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], keep="none"), ["o_custkey", "o_orderkey"]), "SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
add("distinct_all", lambda t: X.unique(t.events.select("user_id", "event_type")), "SELECT DISTINCT user_id, event_type FROM events")

# -- aggregates
G = "FROM lineitem GROUP BY l_returnflag, l_linestatus"
add("groupby_pricing", lambda t: r6(X.groupby(X.where(t.lineitem, "l_shipdate <= timestamp '1998-09-02'"), ["l_returnflag", "l_linestatus"], {"n": ("*", "count"), "sum_qty": ("l_quantity", "sum"), "avg_disc": ("l_discount", "mean")})), "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 6) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
add("groupby_basic", lambda t: r6(X.groupby(t.lineitem, "l_returnflag", {"l_quantity": "sum"})), "SELECT l_returnflag, round(sum(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY 1")
add("groupby_list_spec", lambda t: r6(X.groupby(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_quantity": ["min", "max", "mean"], "l_tax": ["count"]})), f"SELECT l_returnflag, l_linestatus, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(avg(l_quantity), 6) AS l_quantity_mean, count(l_tax) AS l_tax_count {G}")
add("groupby_having_sort_limit", lambda t: X.groupby(t.orders, "o_custkey", {"n": ("*", "count"), "last": ("o_orderkey", "max")}, having={"n": (">", 5)}, sort=["n", "o_custkey"], desc=[True, False], limit=25), "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, o_custkey LIMIT 25")
add("groupby_first_last", lambda t: X.groupby(t.orders, "o_custkey", {"f": ("o_totalprice", "first"), "l": ("o_totalprice", "last")}, order_by="o_orderkey"), "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS f, arg_max(o_totalprice, o_orderkey) AS l FROM orders GROUP BY 1")
add("groupby_std_var_median_nunique", lambda t: r6(X.groupby(t.lineitem, "l_linestatus", {"s": ("l_quantity", "std"), "v": ("l_quantity", "var"), "m": ("l_extendedprice", "median"), "u": ("l_suppkey", "n_unique"), "k": ("l_tax", "len")})), "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS s, round(var_samp(l_quantity), 6) AS v, round(median(l_extendedprice), 6) AS m, count(DISTINCT l_suppkey) AS u, count(*) AS k FROM lineitem GROUP BY 1")
add("count_rows", lambda t: S.count(t.lineitem), "SELECT count(*) AS n FROM lineitem")
add("count_nulls", lambda t: S.count_nulls(left_orders(t).select("c_custkey", "o_orderkey", "o_orderstatus")), "WITH j AS (SELECT * FROM customer LEFT JOIN orders ON c_custkey = o_custkey) SELECT 'c_custkey' AS \"column\", count(*) - count(c_custkey) AS nulls FROM j UNION ALL SELECT 'o_orderkey', count(*) - count(o_orderkey) FROM j UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus) FROM j")
add("nunique_all", lambda t: S.nunique(left_orders(t).select("c_nationkey", "o_orderstatus")), "WITH j AS (SELECT * FROM customer LEFT JOIN orders ON c_custkey = o_custkey) SELECT 'c_nationkey' AS \"column\", count(DISTINCT c_nationkey) AS n_unique FROM j UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) + CAST(max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM j")
add("value_counts", lambda t: S.value_counts(t.events, "event_type"), 'SELECT event_type, count(*) AS "count" FROM events GROUP BY 1')
add("value_counts_norm", lambda t: r6(S.value_counts(t.orders, "o_orderpriority", normalize=True, n=3)), 'WITH c AS (SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT *, round("count" / sum("count") OVER (), 6) AS share FROM c')
add("describe_num", lambda t: r6(S.describe(t.lineitem, ["l_quantity", "l_extendedprice"])), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", count(*) - count({c}) AS null_count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, .25), 6) AS p25, round(quantile_cont({c}, .5), 6) AS p50, round(quantile_cont({c}, .75), 6) AS p75, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
NUM = ["l_quantity", "l_extendedprice", "l_discount"]
PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]
add("corr_matrix", lambda t: r6(S.corr(t.lineitem, NUM)), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in PAIRS))
RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"
add("corr_spearman", lambda t: r6(S.corr(t.lineitem, ["l_quantity", "l_extendedprice"], "spearman")), f"SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(x, y), 6) AS corr FROM (SELECT {RANK.format('l_quantity')} AS x, {RANK.format('l_extendedprice')} AS y FROM lineitem)")
add("corr_kendall", lambda t: r6(S.corr(t.lineitem, ["l_linenumber", "l_discount"], "kendall")), "WITH g AS (SELECT l_linenumber::DOUBLE AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM g a JOIN g b ON a.x < b.x), n AS (SELECT sum(n) AS n FROM g), tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM g GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM g GROUP BY y)) SELECT 'l_linenumber' AS a, 'l_discount' AS b, round(s.s / sqrt((n.n * (n.n - 1) / 2 - tx.t) * (n.n * (n.n - 1) / 2 - ty.t)), 6) AS corr FROM s, n, tx, ty")
add("diff_by_key", lambda t: r6(S.diff(t.customer, X.add_column(t.customer, c_mktsegment=F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))), "c_custkey")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p} AS changed_pct, CAST(0 AS BIGINT) AS nulls_before, CAST({n} AS BIGINT) AS nulls_after FROM customer" for c, p, n in (("c_name", "0.0", "0"), ("c_nationkey", "0.0", "0"), ("c_acctbal", "0.0", "0"), ("c_mktsegment", "round(100.0 * sum(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) / count(*), 6)", "sum(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END)")) if c == "c_mktsegment") + " UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', 0.0, 0, 0" for c in ("c_name", "c_nationkey", "c_acctbal")))

# -- windows
add("top_n_global", lambda t: X.top_n(t.orders.select("o_orderkey", "o_totalprice"), 10, "o_totalprice", tie="o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("top_n_group", lambda t: X.top_n(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), 3, "o_totalprice", group_by="o_orderstatus", tie="o_orderkey"), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 3")
add("shift_lag", lambda t: X.select(X.lag(t.events, 1, columns=["value"], order_by="event_id", partition_by="user_id"), ["event_id", "value"]), "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events")
add("lead_fill", lambda t: X.select(X.lead(t.events, 2, columns=["value"], fill_value=0.0, order_by="event_id", partition_by="user_id"), ["event_id", "value"]), "SELECT event_id, coalesce(lead(value, 2) OVER (PARTITION BY user_id ORDER BY event_id), 0.0) AS value FROM events")

# -- sets and shapes
a_ = lambda t: t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
b_ = lambda t: t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal"))
ka, kb = (lambda t: t.customer.select(F.col("c_nationkey").alias("k"))), (lambda t: t.supplier.where("s_nationkey > 10").select(F.col("s_nationkey").alias("k")))
KB = "(SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 10)"
add("concat_diagonal", lambda t: X.concat([a_(t), b_(t)]), "SELECT c_nationkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
add("union_all", lambda t: X.concat([ka(t), kb(t)]), f"SELECT c_nationkey AS k FROM customer UNION ALL SELECT k FROM {KB}")
add("union_distinct", lambda t: X.union_distinct(ka(t), kb(t)), f"SELECT c_nationkey AS k FROM customer UNION SELECT k FROM {KB}")
add("intersect", lambda t: X.intersect(ka(t), kb(t)), f"SELECT c_nationkey AS k FROM customer INTERSECT SELECT k FROM {KB}")
add("except", lambda t: X.except_(ka(t), kb(t)), f"SELECT c_nationkey AS k FROM customer EXCEPT SELECT k FROM {KB}")
add("pivot_mean", lambda t: r6(X.pivot(t.orders, index="o_orderpriority", columns="o_orderstatus", values="o_totalprice", aggfunc="mean", among=["F", "O", "P"])), "SELECT o_orderpriority, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 6) AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
add("melt_cols", lambda t: X.melt(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), id_cols=["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
add("explode_words", lambda t: X.groupby(X.explode(t.documents.select("doc_id", F.split("text", " ").alias("w")), "w"), "w", {"n": ("*", "count")}), "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
add("explode_parallel", lambda t: X.explode(t.nation.select("n_nationkey", F.split("n_name", "").alias("a"), F.split(F.reverse("n_name"), "").alias("b")), ["a", "b"]), "SELECT n_nationkey, unnest(string_split(n_name, '')) AS a, unnest(string_split(reverse(n_name), '')) AS b FROM nation")

# -- joins
on = lambda t: t.orders.withColumnRenamed("o_custkey", "c_custkey")
some = lambda t: X.where(t.customer, "c_custkey % 2 = 0").select("c_custkey", "c_name")
for how, word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    add(f"join_{how}", lambda t, how=how: X.join(X.where(on(t), "o_orderkey % 3 = 0").select("c_custkey", "o_orderkey"), some(t), "c_custkey", how), f"SELECT coalesce(o_custkey, c_custkey) AS c_custkey, o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_orderkey % 3 = 0) {word} (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
add("join_semi", lambda t: X.join(some(t), X.where(on(t), o_orderstatus="F"), "c_custkey", "semi"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
add("join_anti", lambda t: X.join(some(t), on(t), "c_custkey", "anti"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
# every row takes part; shifted keys leave rows of either side without a partner
far_o = lambda t: t.orders.select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1_000_000_000_000).alias("c_custkey"), "o_orderkey")
far_c = lambda t: t.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-1 - F.col("c_custkey")).alias("c_custkey"), "c_name")
FAR_O = "(SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1000000000000 END AS c_custkey, o_orderkey FROM orders)"
FAR_C = "(SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -1 - c_custkey END AS c_custkey, c_name FROM customer)"
add("join_inner_whole", lambda t: X.join(on(t).select("c_custkey", "o_orderkey"), t.customer.select("c_custkey", "c_name"), "c_custkey", "inner"), "SELECT c_custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
for how, word in (("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    add(f"join_{how}_whole", lambda t, how=how: X.join(far_o(t), far_c(t), "c_custkey", how), f"SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, o_orderkey, c_name FROM {FAR_O} a {word} {FAR_C} b ON a.c_custkey = b.c_custkey")
add("join_semi_whole", lambda t: X.join(t.customer.select("c_custkey", "c_name"), far_o(t), "c_custkey", "semi"), f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM {FAR_O})")
add("join_anti_whole", lambda t: X.join(t.customer.select("c_custkey", "c_name"), far_o(t), "c_custkey", "anti"), f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {FAR_O})")
add("join_cross", lambda t: X.cross_join(t.region.select("r_name"), t.nation.select("n_name")), "SELECT r_name, n_name FROM region, nation")
add("join_range", lambda t: X.range_join(t.customer.select("c_custkey", "c_acctbal"), t.nation.select("n_nationkey", (F.col("n_nationkey") * 400.0 - 500).alias("lo"), (F.col("n_nationkey") * 400.0).alias("hi")), "c_acctbal", "lo", "hi", 500.0).select("c_custkey", "n_nationkey"), "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_acctbal BETWEEN n_nationkey * 400.0 - 500 AND n_nationkey * 400.0")
buy, view = (lambda t: t.events.where("event_id % 2 = 0").select("event_id", "user_id", "ts")), (lambda t: t.events.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("value")))
add("join_asof", lambda t: X.asof_join(buy(t), view(t), "ts", "user_id", ["value"]).select("event_id", "right_value"), "SELECT a.event_id, b.value AS right_value FROM (SELECT * FROM events WHERE event_id % 2 = 0) a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
add("join_suffixes", lambda t: X.join(t.nation.select("n_nationkey", F.col("n_name").alias("name")), t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("name")), "n_nationkey"), "SELECT n_nationkey, n_name AS name_x, c_name AS name_y FROM nation JOIN customer ON n_nationkey = c_nationkey")
add("join_null_safe", lambda t: X.join(X.add_column(t.nation.select("n_nationkey"), k=F.when(F.col("n_nationkey") > 22, F.lit(None)).otherwise(F.col("n_nationkey"))), t.region.select(F.when(F.col("r_regionkey") == 4, F.lit(None)).otherwise(F.col("r_regionkey")).alias("k"), "r_name"), "k", null_safe=True), "SELECT n_nationkey, k, r_name FROM (SELECT n_nationkey, CASE WHEN n_nationkey > 22 THEN NULL ELSE n_nationkey END AS k FROM nation) a JOIN (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END AS k2, r_name FROM region) b ON a.k IS NOT DISTINCT FROM b.k2")


def _duck_hmac(message: str, length: int = 16, key: str = SALT) -> str:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in raw).hex() for x in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message})))), 1, {length})"


add("secure_join_token", lambda t: r6(X.groupby(M.secure_join(on(t).select("c_custkey", "o_totalprice"), t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", salt=SALT), "c_mktsegment", {"n": ("*", "count"), "tokens": ("c_custkey", "nunique"), "low": ("c_custkey", "min"), "total": ("o_totalprice", "sum")})), f"SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS tokens, min({_duck_hmac('CAST(o_custkey AS VARCHAR)')}) AS low, round(sum(o_totalprice), 6) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")

# -- SQL
def _sql(name: str, q: str, duck: str | None = None) -> None:
    names = [n for n in ("region", "nation", "customer", "orders", "lineitem", "events") if n in q]
    add(name, lambda t: r6(sqlmask.run_sql(t.spark, q, **{n: getattr(t, n) for n in names})), duck or q)


_sql("sql_join_having", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 5")
_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("sql_correlated", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)")
_sql("sql_filter_agg", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_returnflag")
add("pipe_chain", lambda t: r6(Pipeline(t.orders).where(o_orderstatus=["F", "O"]).add_column(net=F.col("o_totalprice") * 0.9).groupby("o_orderpriority", {"n": ("*", "count"), "net": ("net", "sum")}).sort("o_orderpriority").df), "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice * 0.9), 6) AS net FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")

# -- detection
people = lambda t: t.customer.select("c_custkey", F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@x.com")).alias("email"), F.concat(F.lit("("), (F.col("c_nationkey") + 11).cast("string"), F.lit(") 9"), F.lpad(F.col("c_custkey").cast("string"), 4, "1"), F.lit("-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "7")).alias("phone"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("postcode"), F.date_add(F.to_date(F.lit("1950-01-01")), (F.col("c_custkey") % 20000).cast("int")).cast("string").alias("born"))
PEOPLE = "(SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@x.com' AS email, '(' || (c_nationkey + 11) || ') 9' || lpad(substr(CAST(c_custkey AS VARCHAR), 1, 4), 4, '1') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '7') AS phone, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS postcode, CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS VARCHAR) AS born FROM customer)"
FULL = {k: p.removeprefix("^").removesuffix("$").replace("'", "''") for k, p in detect.PATTERNS.items() if k not in ("cpf", "cnpj")}


def _ratio_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, " + ", ".join(f"round(avg(CASE WHEN regexp_full_match(trim({c}), '{p}') THEN 1.0 ELSE 0.0 END), 6) AS {k}" for k, p in FULL.items()) + f" FROM {table}" for c in columns)


add("scan_ratios", lambda t: r6(detect.ratios(people(t), {k: detect.PATTERNS[k] for k in FULL}).drop("n_unique")), _ratio_sql(PEOPLE, ["email", "phone", "postcode", "born"]))
reports = lambda spark, found: spark.createDataFrame([(r.column, r.pii_type, r.risk_level, r.mask_strategy, round(float(r.match_ratio), 6)) for r in found.values()], "column string, pii_type string, risk_level string, mask_strategy string, match_ratio double")
_share = lambda c, k: f"(SELECT round(avg(CASE WHEN regexp_full_match(trim({c}), '{FULL[k]}') THEN 1.0 ELSE 0.0 END), 6)::DOUBLE FROM {PEOPLE})"
_found = lambda *rows: "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', '{risk}', '{how}', {r})" for c, k, risk, how, r in rows) + ') v("column", pii_type, risk_level, mask_strategy, match_ratio)'
add("scan_fast", lambda t: reports(t.spark, detect.scan(people(t))), _found(("c_custkey", "numerico", "low", "mock_numeric", "0.0::DOUBLE"), ("email", "email", "high", "hash", _share("email", "email")), *[(c, "telefone", "high", "mask_phone_ddd", _share(c, "telefone")) for c in ("phone", "postcode")]))
add("scan_classic", lambda t: reports(t.spark, detect.scan(t.customer, mode="classic")), _found(("c_name", "nome", "high", "redact", "0.5::DOUBLE")))
add("scan_custom", lambda t: reports(t.spark, detect.scan(t.part.select("p_brand"), custom_patterns={"brand": r"^Brand#\d+$"})), "SELECT 'p_brand' AS \"column\", 'custom_pii:brand' AS pii_type, 'medium' AS risk_level, 'hash' AS mask_strategy, 1.0::DOUBLE AS match_ratio")
add("scan_nested", lambda t: reports(t.spark, detect.scan(people(t).select(F.struct("email", "phone").alias("who"), F.array("email", "email").alias("mails")))), _found(("who.email", "email", "high", "hash", _share("email", "email")), ("who.phone", "telefone", "high", "mask_phone_ddd", _share("phone", "telefone")), ("mails[]", "email", "high", "hash", _share("email", "email"))))
add("scan_sensitive", lambda t: t.spark.createDataFrame([(x["column"], x["category"]) for x in detect.scan_sensitive(t.customer.select(F.col("c_mktsegment").alias("religiao"), F.lit("A01").alias("code_x"), F.col("c_custkey").alias("dna")))], "column string, category string"), "SELECT * FROM (VALUES ('religiao', 'convicção_religiosa'), ('code_x', 'saude_vida_sexual'), ('dna', 'dado_genetico_biometrico')) v(\"column\", category)")
digit = lambda base, w, n: f"CASE WHEN (list_sum(list_transform(range(0, {n}), lambda i: CAST(substring({base}, CAST(i + 1 AS INTEGER), 1) AS INTEGER) * {w}[i + 1]))) % 11 < 2 THEN '0' ELSE CAST(11 - (list_sum(list_transform(range(0, {n}), lambda i: CAST(substring({base}, CAST(i + 1 AS INTEGER), 1) AS INTEGER) * {w}[i + 1]))) % 11 AS VARCHAR) END"
for name, n, w, f in (("cpf", 9, K.CPF_WEIGHTS, K.valid_cpf), ("cnpj", 12, K.CNPJ_WEIGHTS, K.valid_cnpj)):
    add(f"{name}_check", lambda t, n=n, w=w, f=f: t.customer.select("c_custkey", K.with_check_digits(F.lpad((F.col("c_custkey") * 7919 + 123).cast("string"), n, "1"), w).alias("id")).withColumn("ok", f(F.col("id"))).withColumn("bad", f(F.concat(F.col("id"), F.lit("0")))), f"WITH b AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 123 AS VARCHAR), {n}, '1') AS b FROM customer), o AS (SELECT c_custkey, b || {digit('b', w[0], n)} AS o FROM b) SELECT c_custkey, o || {digit('o', w[1], n + 1)} AS id, true AS ok, false AS bad FROM o")

# -- masks
cust = lambda t, **k: people(t).select("c_custkey", *[v.alias(n) for n, v in k.items()])
add("mask_hash_id", lambda t: t.orders.select("o_orderkey", K.token(F.col("o_custkey"), SALT).alias("token")), f"SELECT o_orderkey, {_duck_hmac('CAST(o_custkey AS VARCHAR)')} AS token FROM orders")
add("mask_hash_email", lambda t: cust(t, token=K.token(F.concat(F.lit(" "), F.upper("email")), SALT, "email")), f"SELECT c_custkey, {_duck_hmac('lower(email)')} AS token FROM {PEOPLE}")
add("mask_hash_prefix", lambda t: cust(t, token=K.token(F.col("email"), SALT, length=24, prefix="tok_")), f"SELECT c_custkey, 'tok_' || {_duck_hmac('email', 24)} AS token FROM {PEOPLE}")
add("mask_nullstr", lambda t: cust(t, token=K.token(F.when(F.col("c_custkey") % 2 == 0, "N/A").otherwise(F.col("email")), SALT)), f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN {_duck_hmac('email')} END AS token FROM {PEOPLE}")
add("mask_redact", lambda t: cust(t, email=K.redact(F.col("email"))), f"SELECT c_custkey, 'REDACTED' AS email FROM {PEOPLE}")
add("mask_truncate", lambda t: cust(t, postcode=K.truncate_postcode(F.col("postcode"))), f"SELECT c_custkey, substr(postcode, 1, 5) || '-XXX' AS postcode FROM {PEOPLE}")
add("mask_phone", lambda t: cust(t, phone=K.mask_phone(F.col("phone"))), f"SELECT c_custkey, substr(phone, 1, 3) || ' XXXX-XXXX' AS phone FROM {PEOPLE}")
add("mask_decade", lambda t: cust(t, born=K.decade(F.col("born"))), f"SELECT c_custkey, CAST(CAST(substr(born, 1, 3) AS INTEGER) * 10 AS VARCHAR) || '-' || CAST(CAST(substr(born, 1, 3) AS INTEGER) * 10 + 9 AS VARCHAR) AS born FROM {PEOPLE}")
add("mask_decade_ts", lambda t: t.orders.select("o_orderkey", K.decade(F.col("o_orderdate"), "timestamp", 5).alias("years")), "SELECT o_orderkey, CAST(year(o_orderdate) // 5 * 5 AS VARCHAR) || '-' || CAST(year(o_orderdate) // 5 * 5 + 4 AS VARCHAR) AS years FROM orders")
add("mask_suppress", lambda t: cust(t, email=K.suppress(F.col("email"))), f"SELECT c_custkey, NULL::VARCHAR AS email FROM {PEOPLE}")
add("mask_auto", lambda t: M.mask(people(t), salt=SALT, columns=["email", "phone", "born"]).select("c_custkey", "email", "phone", "born"), f"SELECT c_custkey, {_duck_hmac('email')} AS email, substr(phone, 1, 3) || ' XXXX-XXXX' AS phone, born FROM {PEOPLE}")
add("mask_explicit", lambda t: M.mask(people(t), salt=SALT, reports={"email": detect.ColumnReport("email", "email", "high", "hash", 1.0, 1.0), "postcode": detect.ColumnReport("postcode", "cep", "low", "truncate", 1.0, 1.0)}).select("c_custkey", "email", "postcode"), f"SELECT c_custkey, {_duck_hmac('email')} AS email, substr(postcode, 1, 5) || '-XXX' AS postcode FROM {PEOPLE}")
add("mask_risk_high", lambda t: M.mask(people(t), salt=SALT, risk="high").select("c_custkey", "email"), f"SELECT c_custkey, NULL::VARCHAR AS email FROM {PEOPLE}")
add("mask_mock_num", lambda t: t.customer.select("c_custkey", K.mock_number(F.col("c_acctbal"), -1000.0, 10000.0, False, K.uniform(F.col("c_custkey"), 7)).alias("x")).agg(F.count("x").alias("n"), F.count_if((F.col("x") < -1000) | (F.col("x") > 10000)).alias("out")), "SELECT count(*) AS n, CAST(0 AS BIGINT) AS out FROM customer")
add("mask_mock_cat", lambda t: t.customer.select(K.mock_category(F.col("c_mktsegment"), {"BUILDING": 0.5, "MACHINERY": 0.5}, K.uniform(F.col("c_custkey"), 8)).alias("s")).distinct(), "SELECT unnest(['BUILDING', 'MACHINERY']) AS s")
add("mock_within_group", lambda t: r6(M.mock_within_group(t.customer, "c_acctbal", "c_mktsegment", "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))), "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 6) AS total FROM customer GROUP BY 1")
add("mock_perturb", lambda t: t.customer.select(K.perturb_number(F.col("c_acctbal"), -1000.0, 10000.0, 3000.0, 5).alias("x")).agg(F.count_if((F.col("x") < -1000) | (F.col("x") > 10000)).alias("out")), "SELECT CAST(0 AS BIGINT) AS out")
add("synthetic_people", lambda t: M.synthetic_people(t.spark, 500).agg(F.count("*").alias("n"), F.count_if(K.valid_cpf(F.col("cpf"))).alias("cpf"), F.count_if(K.valid_cnpj(F.col("cnpj"))).alias("cnpj")), "SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS cpf, CAST(500 AS BIGINT) AS cnpj")
add("synthesizer_clone", lambda t: M.clone(t.lineitem.select("l_quantity", "l_extendedprice", "l_returnflag"), 1000))

# -- text
free = lambda k: detect.PATTERNS[k].removeprefix("^").removesuffix("$").replace("'", "''")
for kind in ("email", "ip", "cartao_credito"):
    add(f"text_redact_{kind}", lambda t, kind=kind: t.documents.select("doc_id", F.md5(text.redact_type(F.col("text"), kind).cast("binary")).alias("h")), f"SELECT doc_id, md5(regexp_replace(text, '(?i){free(kind)}', '[{kind.upper()}]', 'g')) AS h FROM documents")
add("text_has_pii", lambda t: t.documents.select("doc_id", text.has_pii(F.col("text"), ["email", "ip"]).alias("found")), f"SELECT doc_id, regexp_matches(text, '(?i)(?:{free('email')})|(?:{free('ip')})') AS found FROM documents")
add("text_spans", lambda t: text.explode_spans(t.documents, "text", "doc_id"))
add("text_mask_redact", lambda t: t.documents.select("doc_id", text.mask_text_column(F.col("text")).alias("text")))
add("text_mask_hash", lambda t: t.documents.select("doc_id", text.mask_text_column(F.col("text"), "hash", SALT).alias("text")))
add("text_mask_partial", lambda t: t.conversations.select("conv_id", "turn", text.mask_text_column(F.col("text"), "partial").alias("text")))

# -- quality
rules = {"o_totalprice": {"min": 50000, "max": 300000, "not_null": True}, "o_orderstatus": {"in": ["F", "O"], "max_length": 1}, "o_orderpriority": {"matches": r"[1-5]-[A-Z ]+", "contains": "URGENT"}, "o_custkey": {"unique": True}}
add("validate_rules", lambda t: Q.rule_counts(t.orders, rules).drop("total"), "WITH v AS (SELECT count_if(o_totalprice < 50000) AS a, count_if(o_totalprice > 300000) AS b, count_if(o_totalprice IS NULL) AS c, count_if(o_orderstatus NOT IN ('F', 'O')) AS d, count_if(length(o_orderstatus) > 1) AS e, count_if(NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')) AS f, count_if(NOT regexp_matches(o_orderpriority, 'URGENT')) AS g FROM orders) SELECT u.* FROM (SELECT unnest(['o_totalprice', 'o_totalprice', 'o_totalprice', 'o_orderstatus', 'o_orderstatus', 'o_orderpriority', 'o_orderpriority']) AS \"column\", unnest(['min', 'max', 'not_null', 'in', 'max_length', 'matches', 'contains']) AS rule, CAST(unnest([a, b, c, d, e, f, g]) AS BIGINT) AS violations FROM v) u UNION ALL SELECT 'o_custkey', 'unique', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
add("validate_schema", lambda t: t.spark.createDataFrame([(r.column, r.rule, r.passed) for r in Q.validate_schema(t.orders, required=["o_orderkey", "nope"], forbidden=["o_orderstatus"], min_rows=10).rules], "column string, rule string, passed boolean"), "SELECT * FROM (VALUES ('o_orderkey', 'required', true), ('nope', 'required', false), ('o_orderstatus', 'forbidden', false), ('*', 'min_rows', true)) v(\"column\", rule, passed)")
con = Q.contract({"c_custkey": {"dtype": "int", "nullable": False}, "c_name": {"dtype": "string", "mask": "redact", "pii": "nome"}, "c_acctbal": {"dtype": "float", "rules": {"min": -2000}}}, name="customers")
add("contract_apply", lambda t: con.apply(t.customer, SALT).df.select("c_custkey", "c_name"), "SELECT c_custkey, 'REDACTED' AS c_name FROM customer")
add("contract_rules", lambda t: Q.rule_counts(t.customer, {n: f.all_rules() for n, f in con.fields.items()}).select("column", "rule", "violations"), "SELECT * FROM (VALUES ('c_custkey', 'not_null', 0), ('c_custkey', 'dtype', 0), ('c_name', 'dtype', 0), ('c_acctbal', 'dtype', 0), ('c_acctbal', 'min', 0)) v(\"column\", rule, violations)")

# -- privacy metrics
QI = ["c_nationkey", "c_mktsegment"]
KG = "(SELECT count(*) AS c, count(DISTINCT round(c_acctbal / 1000)) AS l FROM customer GROUP BY c_nationkey, c_mktsegment)"
add("kanon", lambda t: r6(P.k_anonymity(t.customer, QI)), f"SELECT min(c) AS k, count(*) AS n_groups, CAST(count_if(c = 1) AS BIGINT) AS singletons, round(quantile_cont(c, .25), 6) AS p25, round(quantile_cont(c, .5), 6) AS p50, round(quantile_cont(c, .75), 6) AS p75 FROM {KG}")
add("kanon_hist", lambda t: P.k_histogram(t.customer, QI), f"SELECT c AS group_size, count(*) AS n_groups FROM {KG} GROUP BY 1 ORDER BY 1 LIMIT 10")
add("ldiv", lambda t: P.l_diversity(t.customer.withColumn("bal", F.round(F.col("c_acctbal") / 1000)), QI, "bal"), f"SELECT min(l) AS l, CAST(count_if(l <= 1) AS BIGINT) AS homogeneous, count(*) AS n_groups FROM {KG}")
add("tclose_cat", lambda t: r6(P.t_closeness(t.orders, ["o_orderstatus"], "o_orderpriority")), "WITH p AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1), g AS (SELECT o_orderstatus AS s, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY 1, 2), m AS (SELECT s, sum(c) AS m FROM g GROUP BY 1), d AS (SELECT m.s, CASE WHEN any_value(m.m) < 2 THEN 1.0 ELSE sum(abs(coalesce(g.c, 0) / m.m - p.p)) / 2 END AS t FROM m CROSS JOIN p LEFT JOIN g ON g.s = m.s AND g.v = p.v GROUP BY 1) SELECT round(max(t), 6) AS t_max, round(avg(t), 6) AS t_mean, CAST(count_if(t > 0.2) AS BIGINT) AS violations FROM d")
add("tclose_num", lambda t: r6(P.t_closeness(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", numeric=True)), "WITH b AS (SELECT l_returnflag || l_linestatus AS s, l_quantity AS v FROM lineitem), p AS (SELECT v, count(*) / sum(count(*)) OVER () AS p FROM b GROUP BY 1), h AS (SELECT v, sum(p) OVER (ORDER BY v) AS h, lead(v) OVER (ORDER BY v) - v AS dx FROM p), g AS (SELECT s, v, count(*) AS c FROM b GROUP BY 1, 2), m AS (SELECT s, sum(c) AS m FROM g GROUP BY 1), f AS (SELECT m.s, h.v, h.h, h.dx, sum(coalesce(g.c, 0) / m.m) OVER (PARTITION BY m.s ORDER BY h.v) AS f FROM m CROSS JOIN h LEFT JOIN g ON g.s = m.s AND g.v = h.v), d AS (SELECT s, sum(abs(f - h) * coalesce(dx, 0)) AS t FROM f GROUP BY 1) SELECT round(max(t), 6) AS t_max, round(avg(t), 6) AS t_mean, CAST(count_if(t > 0.2) AS BIGINT) AS violations FROM d")
add("risk_score", lambda t: r6(P.reidentification_risk(t.customer, QI, ["c_name"], [])), "WITH g AS (SELECT count(*) AS c FROM customer GROUP BY c_nationkey, c_mktsegment), u AS (SELECT 0.6 * (SELECT count_if(c = 1) / count(*) FROM g) + 0.4 * (count(DISTINCT c_nationkey) / count(*) + count(DISTINCT c_mktsegment) / count(*)) / 2 AS uniqueness FROM customer), i AS (SELECT ((SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM customer GROUP BY c_nationkey)) + (SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM customer GROUP BY c_mktsegment))) / 2 AS inference) SELECT round(uniqueness, 6) AS uniqueness, round(inference, 6) AS inference, 1.0::DOUBLE AS structural, round(0.5 * uniqueness + 0.3 * inference + 0.2, 6) AS risk_score FROM u, i")
add("privacy_score", lambda t: t.spark.createDataFrame([P.privacy_score(t.customer, detect.scan(t.customer), QI)], "total int, grade string, exposure int, k_anonymity int, risk int, density int, nulls int, k long, risk_score double"))
side = lambda t, f: t.lineitem.where(F.col("l_returnflag") == f)
A_, B_ = "(SELECT * FROM lineitem WHERE l_returnflag = 'A')", "(SELECT * FROM lineitem WHERE l_returnflag = 'N')"
add("psi_equal_width", lambda t: r6(P.psi_equal_width(side(t, "A"), side(t, "N"), "l_extendedprice")), f"WITH r AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT l_extendedprice AS v FROM {A_} UNION ALL SELECT l_extendedprice FROM {B_})), a AS (SELECT least(9, floor((l_extendedprice - lo) / ((hi - lo) / 10))) AS b, count(*) AS n FROM {A_}, r GROUP BY 1), c AS (SELECT least(9, floor((l_extendedprice - lo) / ((hi - lo) / 10))) AS b, count(*) AS n FROM {B_}, r GROUP BY 1), s AS (SELECT CASE WHEN coalesce(a.n, 0) = 0 THEN 1e-6 ELSE a.n / (SELECT sum(n) FROM a) END AS p, CASE WHEN coalesce(c.n, 0) = 0 THEN 1e-6 ELSE c.n / (SELECT sum(n) FROM c) END AS q FROM range(10) g(i) LEFT JOIN a ON a.b = i LEFT JOIN c ON c.b = i) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s")
add("psi_quantile", lambda t: r6(P.psi_quantile(side(t, "A"), side(t, "N"), "l_extendedprice")), f"WITH e AS (SELECT list_transform(range(1, 10), lambda i: quantile) AS x FROM (SELECT NULL AS quantile)), q AS (SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {i / 10}) AS q{i}" for i in range(1, 10)) + f" FROM {A_}), a AS (SELECT " + " + ".join(f"CASE WHEN l_extendedprice >= q{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + f" AS b, count(*) AS n FROM {A_}, q GROUP BY 1), c AS (SELECT " + " + ".join(f"CASE WHEN l_extendedprice >= q{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + f" AS b, count(*) AS n FROM {B_}, q GROUP BY 1), s AS (SELECT CASE WHEN coalesce(a.n, 0) = 0 THEN 1e-3 ELSE a.n / (SELECT sum(n) FROM a) END AS p, CASE WHEN coalesce(c.n, 0) = 0 THEN 1e-3 ELSE c.n / (SELECT sum(n) FROM c) END AS q FROM range(10) g(i) LEFT JOIN a ON a.b = i LEFT JOIN c ON c.b = i) SELECT round(abs(sum((q - p) * ln(q / p))), 6) AS psi FROM s")
add("ks_stat", lambda t: r6(P.ks(side(t, "A"), side(t, "N"), "l_extendedprice")), f"WITH u AS (SELECT l_extendedprice AS v, 1 AS a, 0 AS b FROM {A_} UNION ALL SELECT l_extendedprice, 0, 1 FROM {B_}), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1) SELECT round(max(d), 6) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS d FROM g)")
SH = f"s AS (SELECT coalesce(a.p, 0) AS p, coalesce(b.q, 0) AS q FROM (SELECT l_linenumber AS v, count(*) / sum(count(*)) OVER () AS p FROM {A_} GROUP BY 1) a FULL JOIN (SELECT l_linenumber AS v, count(*) / sum(count(*)) OVER () AS q FROM {B_} GROUP BY 1) b ON a.v = b.v)"
add("kl_clipped", lambda t: r6(P.kl_clipped(side(t, "A"), side(t, "N"), "l_linenumber")), f"WITH {SH}, n AS (SELECT (p + 1e-9) / sum(p + 1e-9) OVER () AS p, (q + 1e-9) / sum(q + 1e-9) OVER () AS q FROM s) SELECT round(least(1.0, sum(p * ln(p / q))), 6) AS kl_clipped FROM n")
add("jsd", lambda t: r6(P.jsd(side(t, "A"), side(t, "N"), "l_linenumber")), f"WITH {SH} SELECT round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS jsd FROM s")
TK = "SELECT l_suppkey AS v FROM {} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10"
add("topk_overlap", lambda t: r6(P.top_k_overlap(side(t, "A"), side(t, "N"), "l_suppkey")), f"SELECT round((SELECT count(*) FROM (SELECT * FROM ({TK.format(A_)}) INTERSECT SELECT * FROM ({TK.format(B_)}))) / (SELECT count(*) FROM (SELECT * FROM ({TK.format(A_)}) UNION SELECT * FROM ({TK.format(B_)}))), 6) AS overlap")
add("corr_delta", lambda t: r6(P.correlation_delta(side(t, "A"), side(t, "N"), NUM)), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(x - y), 6) AS delta, abs(x - y) >= 0.05 AS changed FROM (SELECT (SELECT corr({a}, {b}) FROM {A_}) AS x, (SELECT corr({a}, {b}) FROM {B_}) AS y)" for a, b in PAIRS))
add("utility_metrics", lambda t: r6(P.utility(side(t, "A"), side(t, "N"), ["l_quantity", "l_extendedprice"])), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(x.m - y.m) / greatest(abs(x.m), 1e-9) * 100, 6) AS mean_diff_pct, round(abs(x.s - y.s) / greatest(abs(x.s), 1e-9) * 100, 6) AS std_diff_pct, k.ks, p.psi FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {A_}) x, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {B_}) y, ({_SQL['ks_stat'].replace('l_extendedprice', c)}) k, ({_SQL['psi_equal_width'].replace('l_extendedprice', c)}) p" for c in ("l_quantity", "l_extendedprice")))
add("dcr_nndr", lambda t: r6(P.nearest_distances(side(t, "A"), side(t, "N"), ["l_quantity", "l_extendedprice"])))
dp = lambda: P.DifferentialPrivacy(1.0, seed=9)
add("dp_laplace", lambda t: dp().laplace_columns(t.lineitem.select("l_orderkey", "l_quantity"), ["l_quantity"]))
add("dp_gaussian", lambda t: dp().gaussian_columns(t.lineitem.select("l_orderkey", "l_quantity"), ["l_quantity"]))
add("dp_randomized_response", lambda t: dp().randomized_response(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
add("dp_count", lambda t: dp().count(t.lineitem))
add("dp_mean", lambda t: dp().mean(t.lineitem, "l_quantity", 0, 50))
add("dp_histogram", lambda t: dp().histogram(t.lineitem, "l_returnflag"))
# What must hold whatever the noise: exact sizes, bounds, and distances that noise of epsilon 1 passes once in e^40 times
_near = lambda noisy, exact, most: (F.abs(F.col(noisy) - F.col(exact)) <= most).alias("near")
for kind in ("laplace", "gaussian"):
    add(f"dp_{kind}_bounds", lambda t, kind=kind: getattr(dp(), f"{kind}_columns")(t.lineitem.select("l_quantity"), ["l_quantity"]).crossJoin(t.lineitem.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))).agg(F.count("l_quantity").alias("n"), F.count_if((F.col("l_quantity") < F.col("lo")) | (F.col("l_quantity") > F.col("hi"))).alias("out")), "SELECT count(l_quantity) AS n, CAST(0 AS BIGINT) AS out FROM lineitem")
add("dp_count_near", lambda t: dp().count(t.lineitem).withColumnRenamed("n", "noisy").crossJoin(t.lineitem.agg(F.count("*").alias("n"))).select("n", _near("noisy", "n", 40)), "SELECT count(*) AS n, true AS near FROM lineitem")
add("dp_mean_near", lambda t: dp().mean(t.lineitem, "l_quantity", 0, 50).crossJoin(t.lineitem.agg(F.avg(F.least("l_quantity", F.lit(50))).alias("m"), F.count("*").alias("n"))).select("n", (F.abs(F.col("mean") - F.col("m")) <= 40 * 50 / F.col("n")).alias("near")), "SELECT count(*) AS n, true AS near FROM lineitem")
add("dp_histogram_near", lambda t: dp().histogram(t.lineitem, "l_returnflag").withColumnRenamed("n", "noisy").join(t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n")), "l_returnflag").select("l_returnflag", "n", _near("noisy", "n", 40)), "SELECT l_returnflag, count(*) AS n, true AS near FROM lineitem GROUP BY 1")


# -- sealed datasets
def _sealed(t: Tables, filters=None, columns=None) -> DataFrame:
    path = scratch(t, "sealed")
    sealed.write(t.orders, path, KEY, chunk_rows=2000, order_by=["o_orderkey"])
    return sealed.read(t.spark, path, KEY, columns=columns, filters=filters)


def _multi(t: Tables) -> DataFrame:
    path = scratch(t, "bundle")
    sealed.write_frames({"n": t.nation, "r": t.region}, path, KEY, levels={"n": "staff", "r": "public"})
    return sealed.read_frames(t.spark, path, KEY, ["staff"])["n"]


def _rekey(t: Tables) -> DataFrame:
    a, b = scratch(t, "sealed"), scratch(t, "sealed")
    sealed.write(t.nation, a, KEY)
    sealed.rekey(t.spark, a, KEY, KEY + "2", b)
    return sealed.read(t.spark, b, KEY + "2")


def _stats(t: Tables) -> DataFrame:
    path = scratch(t, "sealed")
    sealed.write(t.orders.select("o_orderkey", "o_totalprice"), path, KEY, chunk_rows=2000, order_by=["o_orderkey"])
    chunks = t.spark.read.parquet(f"{path}/chunks")
    kept = sealed.prune(chunks, normalize_filters({"o_orderkey": ("<", 500)}), ["o_orderkey", "o_totalprice"])
    return chunks.agg(F.sum("n_rows").alias("n_rows"), F.min("stats.o_orderkey.min").alias("low"), F.max("stats.o_orderkey.max").alias("high"), F.max("stats.o_totalprice.nulls").alias("nulls")).crossJoin(kept.agg((F.count("*") >= 1).alias("kept_some")))  # single rows


add("sealed_roundtrip", lambda t: _sealed(t), "SELECT * FROM orders")
add("sealed_pruned", lambda t: _sealed(t, {"o_orderkey": (100, 900), "o_orderstatus": ["F", "O"]}, ["o_orderkey", "o_totalprice"]), ORD + "o_orderkey BETWEEN 100 AND 900 AND o_orderstatus IN ('F', 'O')")
add("sealed_empty", lambda t: _sealed(t, {"o_orderkey": (">", 10**12)}, ["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000000000000")
add("sealed_multi_acl", _multi, "SELECT * FROM nation")
add("sealed_rekey", _rekey, "SELECT * FROM nation")
add("chunk_stats", _stats, "SELECT CAST(count(*) AS BIGINT) AS n_rows, min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(0 AS BIGINT) AS nulls, true AS kept_some FROM orders")

# -- tracing
add("canary_strip_roundtrip", lambda t: trace.strip_canary(trace.inject_canary(t.orders, "p1", SALT)[0]), "SELECT * FROM orders")
add("canary_fingerprints", lambda t: trace.inject_canary(t.customer, "p1", SALT)[0].where(F.col(trace.MARK).isNotNull()).select(F.col(trace.MARK).alias("sig")), " UNION ALL ".join(f"SELECT '{trace.fingerprint(SALT, 'p1', i)}' AS sig" for i in range(3)))


def _wm_text(t: Tables) -> DataFrame:
    docs, entry = trace.watermark_texts(t.documents, "text", "doc_id", "c1", SALT)
    return trace.strip_text_watermarks(docs, "text", entry).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


def _wm_vec(t: Tables) -> DataFrame:
    out, entry = trace.watermark_embeddings(t.embeddings, "embedding", "vec_id", "c1", SALT)
    both = out.select("vec_id", F.col("embedding").alias("y")).join(t.embeddings, "vec_id")
    gap = F.sqrt(F.aggregate(F.zip_with("embedding", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    return both.agg(F.count_if(gap > 0).alias("moved"), F.count_if(gap > 0.0011 * norm).alias("too_far"))


add("wm_text_roundtrip", _wm_text, "SELECT doc_id, md5(text) AS h FROM documents")
add("wm_embedding_norm", _wm_vec, "SELECT CAST(5 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS too_far")

# -- partial reads, inventories, SQL masks
lp = lambda t: f"{t.sf_dir}/lineitem.parquet"
KEYS = ["l_orderkey", "l_linenumber"]
add("partial_head", lambda t: files.read_partial(t.spark, lp(t), head=10, order_by=KEYS).select(*KEYS), "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2 LIMIT 10")
add("partial_tail", lambda t: files.read_partial(t.spark, lp(t), tail=10, order_by=KEYS).select(*KEYS), "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY 1 DESC, 2 DESC LIMIT 10")
add("partial_chunks", lambda t: X.concat([files.read_partial(t.spark, lp(t), chunks=[c], n_chunks=4, columns=KEYS) for c in (1, 2, 3, 4)]), "SELECT l_orderkey, l_linenumber FROM lineitem")


def _csv(t: Tables) -> str:
    path = scratch(t, "orders") + ".csv"
    files.write(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").repartition(3, "o_orderkey"), path)
    return path


def _csv_chunks(t: Tables) -> DataFrame:
    path = _csv(t)
    return X.concat([files.read_partial(t.spark, path, chunks=c, n_chunks=4).withColumn("chunk", F.lit(c)) for c in (1, 2, 3, 4)])


add("partial_csv_chunks", lambda t: _csv_chunks(t).select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
add("partial_csv_sizes", lambda t: _csv_chunks(t).groupBy("chunk").agg(F.count("*").alias("n")), "SELECT k.chunk, CASE WHEN k.chunk < 4 THEN a.n // 4 ELSE a.n - 3 * (a.n // 4) END AS n FROM (VALUES (1), (2), (3), (4)) AS k(chunk), (SELECT count(*) AS n FROM orders) AS a")
add("header_stats", lambda t: files.header_frame(t.spark, lp(t)).where(F.col("column").isin("l_orderkey", "l_quantity", "l_extendedprice")).select("column", "nulls", F.col("least").cast("double").alias("least"), F.col("largest").cast("double").alias("largest"), "rows"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, min({c})::DOUBLE AS least, max({c})::DOUBLE AS largest, count(*) AS rows FROM lineitem" for c in ("l_orderkey", "l_quantity", "l_extendedprice")))
add("profile_nulls_dtypes", lambda t: S.profile_columns(left_orders(t).select("c_custkey", "o_orderkey", "o_orderstatus")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS nulls, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique FROM (SELECT * FROM customer LEFT JOIN orders ON c_custkey = o_custkey)" for c, k in (("c_custkey", "bigint"), ("o_orderkey", "bigint"), ("o_orderstatus", "string"))))
add("upsert", lambda t: files.upsert(t.nation, t.nation.where("n_nationkey < 3").withColumn("n_name", F.lit("NEW")), ["n_nationkey"]), "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'NEW' ELSE n_name END AS n_name, n_regionkey FROM nation")
name_report = {"c_name": detect.ColumnReport("c_name", "nome", "medium", "redact", 0.5, 1.0), "m": detect.ColumnReport("m", "quasi_identifier", "low", "truncate", 0.5, 0.1)}
add("mask_sql_spark", lambda t: sqlmask.masked_query(t.spark, "SELECT c.c_custkey, c.c_name, c.c_mktsegment AS m FROM customer c WHERE c.c_acctbal > 0", name_report, SALT, customer=t.customer), "SELECT c_custkey, 'REDACTED' AS c_name, substr(c_mktsegment, 1, 5) || '-XXX' AS m FROM customer WHERE c_acctbal > 0")
add("masked_view", lambda t: sqlmask.masked_view(t.customer.select("c_custkey", "c_name"), "masked_customers", name_report, SALT), "SELECT c_custkey, 'REDACTED' AS c_name FROM customer")


# -- streams
def _stream(t: Tables, make, mode: str = "append") -> DataFrame:
    top = scratch(t, "stream")
    src = stream.source(t.spark, f"{t.sf_dir}/events.parquet")
    stream.run_to(make(src), f"{top}/out", f"{top}/state", mode)
    return t.spark.read.parquet(f"{top}/out")


def _complete(t: Tables, make) -> DataFrame:
    """A windowed stream, flushed through a batch sink that keeps the latest state of each window."""
    top = scratch(t, "stream")
    src = stream.source(t.spark, f"{t.sf_dir}/events.parquet")
    stream.each_batch(make(src), lambda df, n: df.write.mode("overwrite").parquet(f"{top}/out"), f"{top}/state", "complete")
    return t.spark.read.parquet(f"{top}/out")


sums = lambda: [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]
add("stream_mask", lambda t: _stream(t, lambda s: s.select("event_id", K.token(F.col("user_id"), SALT).alias("user"))), f"SELECT event_id, {_duck_hmac('CAST(user_id AS VARCHAR)')} AS \"user\" FROM events")
add("stream_tumbling", lambda t: _complete(t, lambda s: stream.tumbling(s, "ts", "1 hour", ["event_type"], sums())), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
add("stream_sliding", lambda t: _complete(t, lambda s: stream.sliding(s, "ts", "2 hours", "1 hour", ["event_type"], sums())), "SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w, * FROM events) GROUP BY 1, 2, 3")
add("stream_session", lambda t: _complete(t, lambda s: stream.sessions(s, "ts", "30 minutes", ["user_id"], sums())), "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
add("stream_dedup", lambda t: _stream(t, lambda s: stream.dedup(s, "ts", ["event_id"]).select("event_id")), "SELECT DISTINCT event_id FROM events")
