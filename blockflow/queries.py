"""Queries of the engine's operators over the given tables, and the same in SQL."""

from __future__ import annotations

import contextlib
import io
import json
import sqlite3
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang import assertions
from .operators import streams
from .operators.transforms import transform
from .plans.engine import Hooks, run_script
from .plans.store import GlobalStore
from .sources import excel, http_json, literal, outputs, plugins
from .streaming.downsample import downsample

Query = Callable[[SparkSession, str], DataFrame]
_made: dict[str, tuple[Query, str | None]] = {}
T0, T1 = "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def views(spark: SparkSession, d: str, *names: str) -> None:
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _made[f.__name__] = f, sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*)::double AS n FROM lineitem GROUP BY 1, 2")
def agg_group(spark: SparkSession, d: str) -> DataFrame:
    out = transform({"lineitem": table(spark, d, "lineitem")}, "AGGREGATE l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price, MIN(l_discount) AS min_disc, MAX(l_tax) AS max_tax, COUNT(1) AS n GROUP BY l_returnflag, l_linestatus")
    return rounded(out, "sum_qty", "avg_price")


def _by_status(name: str, body: str, sql: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return rounded(transform({"orders": table(spark, d, "orders")}, f"AGGREGATE o_orderstatus, {body} AS v GROUP BY o_orderstatus"), "v")

    f.__name__ = name
    query(f"SELECT o_orderstatus, round({sql}, 2) AS v FROM orders GROUP BY 1")(f)


_by_status("agg_sum", "SUM(o_totalprice)", "sum(o_totalprice)")
_by_status("agg_avg", "AVG(o_totalprice)", "avg(o_totalprice)")
_by_status("agg_min", "MIN(o_totalprice)", "min(o_totalprice)")
_by_status("agg_max", "MAX(o_totalprice)", "max(o_totalprice)")
_by_status("agg_count", "COUNT(1)", "count(*)::double")


@query("SELECT l_lang, count(k)::double AS n FROM (SELECT lang AS l_lang, CASE WHEN n_chars > 1000 THEN n_chars END AS k FROM documents) GROUP BY 1")
def agg_count_col(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("l_lang"), F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("k"))
    return transform({"docs": docs}, "AGGREGATE l_lang, COUNT(k) AS n GROUP BY l_lang")


def _time(name: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        orders = table(spark, d, "orders").select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"))
        return transform({"orders": orders}, f"AGGREGATE o_orderstatus, {name.upper()}(t) AS v GROUP BY o_orderstatus")

    f.__name__ = f"agg_{name}_time"
    query(f"SELECT o_orderstatus, floor(epoch({name}(o_orderdate)))::double AS v FROM orders GROUP BY 1")(f)


_time("min")
_time("max")


@query("SELECT round(sum(p_retailprice), 2) AS total, count(*)::double AS n FROM part HAVING count(*) > 0")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(transform({"part": table(spark, d, "part")}, "AGGREGATE SUM(p_retailprice) AS total, COUNT(1) AS n"), "total")


@query("SELECT DISTINCT lang, source FROM documents")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return transform({"documents": table(spark, d, "documents")}, "AGGREGATE lang, source GROUP BY lang, source")


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.75)::double AS q FROM lineitem GROUP BY 1")
def agg_quantile(spark: SparkSession, d: str) -> DataFrame:
    return transform({"lineitem": table(spark, d, "lineitem")}, "AGGREGATE l_returnflag, QUANTILE(l_quantity, 0.75) AS q GROUP BY l_returnflag")


@query("SELECT event_type, round(avg(CASE WHEN value <= 5 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END)::double, 6) AS p FROM events GROUP BY 1")
def agg_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(transform({"events": table(spark, d, "events")}, "AGGREGATE event_type, CDF(value, 5) AS p GROUP BY event_type"), "p", digits=6)


@query(f"""
WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS v, epoch_us(TIMESTAMP '2024-01-01') / 1e6 AS a, epoch_us(TIMESTAMP '2024-01-31') / 1e6 AS b FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
h AS (SELECT *, greatest(0.0, least(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), b), b) - greatest(t, a)) AS hold FROM p)
SELECT user_id, round(CASE WHEN min(t) <= max(a) THEN sum(v * hold) / (max(b) - max(a)) END, 4) AS mean FROM h GROUP BY 1 -- {T0} {T1}
""")
def agg_zoh(spark: SparkSession, d: str) -> DataFrame:
    out = transform({"events": table(spark, d, "events")}, f"AGGREGATE user_id, ZOH(ts, value, '{T0}', '{T1}') AS mean GROUP BY user_id")
    return rounded(out, "mean", digits=4)


@query("""
WITH p AS (SELECT event_type, ts AS t, coalesce(lead(ts) OVER (PARTITION BY event_type ORDER BY ts), TIMESTAMP '2024-02-01') AS u, value AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT TIMESTAMP '2024-01-01' + i * INTERVAL 1 DAY AS a, TIMESTAMP '2024-01-01' + (i + 1) * INTERVAL 1 DAY AS b FROM range(31) r(i)),
x AS (SELECT event_type, a, v, epoch_us(least(u, b)) - epoch_us(greatest(t, a)) AS hold FROM p JOIN w ON t < b AND u > a WHERE u > t)
SELECT event_type, strftime(a, '%Y-%m-%d') AS day, round(sum(v * hold) / sum(hold), 4) AS mean FROM x GROUP BY event_type, a HAVING sum(hold) = 86400000000
""")
def zoh_downsample(spark: SparkSession, d: str) -> DataFrame:
    out = downsample(table(spark, d, "events"), ["event_type"], "ts", "value", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "1 DAY")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.round("value", 4).alias("mean"))


@query("SELECT o_orderkey, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_inner(spark: SparkSession, d: str) -> DataFrame:
    return transform({"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer")}, "LOOKUP orders.o_orderkey, customer.c_name AS customer FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def lookup_outer(spark: SparkSession, d: str) -> DataFrame:
    return transform({"orders": table(spark, d, "orders"), "rich": table(spark, d, "customer").where("c_acctbal > 5000")}, "LOOKUP orders.o_orderkey, rich.c_name FROM orders OUTER JOIN rich ON rich.c_custkey = orders.o_custkey")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS qty FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def lookup_multikey(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem")
    b = a.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return transform({"a": a, "b": b}, "LOOKUP a.l_orderkey, a.l_linenumber, b.l_quantity AS qty FROM a INNER JOIN b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber")


_NULLED = "SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS k, c_custkey FROM customer"


@query(f"SELECT c_custkey, n_name FROM ({_NULLED}) c JOIN (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS k, n_name FROM nation) n ON c.k IS NOT DISTINCT FROM n.k")
def lookup_nullkey(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.when(F.col(c) != 3, F.col(c)).alias("k")
    c, n = table(spark, d, "customer").select(key("c_nationkey"), "c_custkey"), table(spark, d, "nation").select(key("n_nationkey"), "n_name")
    return transform({"c": c, "n": n}, "LOOKUP c.c_custkey, n.n_name FROM c INNER JOIN n ON c.k = n.k")


@query("SELECT o_orderkey, b.p AS last_part FROM orders JOIN (SELECT l_orderkey, arg_max(l_partkey, l_linenumber) AS p FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1) b ON o_orderkey = l_orderkey")
def lookup_dup_last(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey")).orderBy("l_linenumber")
    return transform({"orders": table(spark, d, "orders"), "lines": lines}, "LOOKUP orders.o_orderkey, lines.l_partkey AS last_part FROM orders INNER JOIN lines ON orders.o_orderkey = lines.l_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def lookup_semi_shape(spark: SparkSession, d: str) -> DataFrame:
    return transform({"c": table(spark, d, "customer"), "n": table(spark, d, "nation").where("n_regionkey = 1")}, "LOOKUP c.c_custkey FROM c INNER JOIN n ON c.c_nationkey = n.n_nationkey")


@query("SELECT c_custkey, c_name AS name FROM customer")
def apply_project(spark: SparkSession, d: str) -> DataFrame:
    return transform({"c": table(spark, d, "customer")}, "APPLY c_custkey, C_NAME AS name")


@query("SELECT p_partkey, trunc(p_retailprice)::bigint AS price, p_size::bigint AS size, p_partkey AS again FROM part")
def cast_int(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("t", F.col("p_partkey").cast("string"))
    return transform({"p": part}, "APPLY p_partkey, CAST(p_retailprice AS INT) AS price, CAST(p_size AS INT) AS size, CAST(t AS INT) AS again")


@query("SELECT p_partkey, printf('%.6f', p_retailprice) AS price, p_size::varchar AS size FROM part")
def cast_varchar(spark: SparkSession, d: str) -> DataFrame:
    return transform({"p": table(spark, d, "part")}, "APPLY p_partkey, CAST(p_retailprice AS VARCHAR) AS price, CAST(p_size AS VARCHAR) AS size")


@query("SELECT o_orderkey, floor(epoch(o_orderdate))::bigint AS t, o_orderkey AS u FROM orders")
def cast_datetime(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("s"))
    out = transform({"o": orders}, "APPLY o_orderkey, CAST(s AS DATETIME) AS t, CAST(o_orderkey AS DATETIME) AS u")
    return out.select("o_orderkey", F.unix_seconds("t").alias("t"), F.unix_seconds("u").alias("u"))


@query("SELECT c_custkey, (c_acctbal > 0)::int::bigint AS i, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS s FROM customer")
def cast_bool(spark: SparkSession, d: str) -> DataFrame:
    return transform({"c": table(spark, d, "customer").withColumn("b", F.col("c_acctbal") > 0)}, "APPLY c_custkey, CAST(b AS INT) AS i, CAST(b AS VARCHAR) AS s")


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def union_fanin(spark: SparkSession, d: str) -> DataFrame:
    return streams.fan_in([table(spark, d, "region").select(F.col("r_name").alias("name")), table(spark, d, "nation").select("n_name")])


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def union_ordered(spark: SparkSession, d: str) -> DataFrame:
    return streams.ordered_fan_in([table(spark, d, "region").select(F.col("r_name").alias("name")), table(spark, d, "nation").select("n_name")])


@query("SELECT 'a' AS branch, count(*) AS n FROM nation UNION ALL SELECT 'b', count(*) FROM nation")
def fanout(spark: SparkSession, d: str) -> DataFrame:
    """One block read by two others, whose sinks are one table."""
    views(spark, d, "nation")
    j = run_script(
        spark,
        """
        GLOBAL 'Init' ( CREATE TABLE branches (branch text, n bigint); )
        QUERY 'N' FROM GLOBAL ( SELECT n_nationkey FROM nation )
        QUERY 'A' FROM BLOCK N ( SELECT 'a' AS branch, count(*) AS n FROM N ) INTO GLOBAL WITH (TABLE = 'branches')
        QUERY 'B' FROM BLOCK N ( SELECT 'b' AS branch, count(*) AS n FROM N ) INTO GLOBAL WITH (TABLE = 'branches')
        """,
    )
    return j.store.table("branches")


@query("SELECT event_type AS branch, count(*) AS n FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1")
def route_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return streams.fan_in([x.agg(F.lit(n).alias("branch"), F.count("*").alias("n")) for n, x in streams.route(e, "event_type", names).items()])


@query("SELECT c_custkey, c_acctbal AS bal FROM customer WHERE c_acctbal > 0")
def drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    return streams.drop_nulls(table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal")))


_VALUES = "SELECT * FROM (VALUES (1.0::double, 'A'), (2.0, 'B'), (3.0, 'C')) t(a, b)"


@query(_VALUES)
def data_json_array(spark: SparkSession, d: str) -> DataFrame:
    return literal.literal(spark, '[[1,"A"],[2,"B"],[3,"C"]]', "JSON_ARRAY", ["a", "b"])


@query(_VALUES)
def data_json_objects(spark: SparkSession, d: str) -> DataFrame:
    return literal.literal(spark, '[{"a":1,"B":"A"},{"b":"B","a":2},{"A":3,"b":"C"}]', "JSON_OBJECTS", ["a", "b"])


@query("SELECT * FROM (VALUES ('1', 'A'), ('2', 'B, b'), ('3', 'C')) t(a, b)")
def data_csv(spark: SparkSession, d: str) -> DataFrame:
    return literal.literal(spark, '1,A\n2,"B, b"\n3,C', "CSV", ["a", "b"])


@query("SELECT 3.0::double AS Total")
def data_extern(spark: SparkSession, d: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "values.json").write_text('[[1,"A"],[2,"B"]]')
        j = run_script(spark, "DATA 'Values' EXTERN 'values.json' WITH (COLUMNS = 'Number,Letter') TRANSFORM 'Total' FROM BLOCK Values (AGGREGATE SUM(Number) AS Total) INTO CONSOLE WITH (OUTPUT_FORMAT = 'JSON')", base=Path(folder), out=io.StringIO())
    return j.frames["total"]


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def query_sql(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "customer", "nation")
    return GlobalStore(spark).query("SELECT n_name, count(*) AS 'customers' FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
def query_filter(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "lineitem")
    return GlobalStore(spark).query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > ? AND l_discount >= ?", [45, 0.05])


@query("SELECT * FROM nation")
def table_scan(spark: SparkSession, d: str) -> DataFrame:
    """A database's table, filled by one block and read whole by name by another."""
    views(spark, d, "nation")
    with tempfile.TemporaryDirectory() as folder:
        file = f"{folder}/scan.db"
        with contextlib.closing(sqlite3.connect(file)) as link:
            link.execute("CREATE TABLE nations (n_nationkey int, n_name text, n_regionkey int)")
        j = run_script(
            spark,
            f"""
            CONNECTION 'Store' (Driver = 'sqlite3', ConnectionString = '{file}')
            QUERY 'Fill' FROM GLOBAL (SELECT * FROM nation) INTO CONNECTION Store WITH (TABLE = 'nations')
            TRANSFORM 'Scan' FROM CONNECTION Store (APPLY n_nationkey, n_name, n_regionkey) INTO CONSOLE WITH (TABLE = 'nations') AFTER Fill
            """,
            out=io.StringIO(),
        )
        return j.frames["scan"].selectExpr("int(n_nationkey) AS n_nationkey", "n_name", "int(n_regionkey) AS n_regionkey")


def _store(spark: SparkSession, d: str) -> GlobalStore:
    s = GlobalStore(spark)
    s.execute("CREATE TABLE big_regions (id INTEGER PRIMARY KEY, name TEXT NOT NULL, size REAL)")
    s.append("big_regions", table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1.5).alias("size")))
    return s


@query("SELECT r_regionkey::bigint AS id, r_name AS name, 1.5::double AS size FROM region")
def global_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).table("big_regions")


@query("SELECT r_regionkey::bigint AS id FROM region WHERE r_name ILIKE '%a'")
def query_global(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).query("SELECT id FROM big_regions WHERE name LIKE '%A'")


@query("SELECT r_regionkey::bigint AS id, r_name AS name, 1.5::double AS size FROM region")
def global_scan(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).table("BIG_REGIONS")


@query("SELECT r_regionkey::bigint AS id, r_name AS name, 1.5::double AS size FROM region")
def sink_table(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).query("SELECT * FROM big_regions")


@query("SELECT * FROM (VALUES (1::bigint, 'Bob', 8.0::double), (2, 'Steven', 0.0)) t(id, first_name, calls)")
def global_init(spark: SparkSession, d: str) -> DataFrame:
    s = GlobalStore(spark)
    s.execute("CREATE TABLE init_stats (id int, first_name text, calls real); INSERT INTO init_stats VALUES (1, 'Bob', 8), (2, 'Steven', 0);")
    return s.table("init_stats")


@query("SELECT r_regionkey::bigint AS id, CASE WHEN r_regionkey = 1 THEN 'X' ELSE r_name END AS name, 1.5::double AS size FROM region WHERE r_regionkey <> 2")
def exec_stmt(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d)
    s.execute("DELETE FROM big_regions WHERE id = ?; UPDATE big_regions SET name = 'X' WHERE id = 1", [2])
    return s.table("big_regions")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment ILIKE '%build%'")
def autosql(spark: SparkSession, d: str) -> DataFrame:
    """SQL over a connection that has none: pages of JSON."""
    names = [r[0] for r in table(spark, d, "customer").select("c_mktsegment").collect()]

    def pages(url: str, _: dict[str, str]) -> str:
        at = int(url.rpartition("skip=")[2])
        return json.dumps({"items": [{"segment": x} for x in names[at : at + 500]]})

    j = run_script(
        spark,
        """
        CONNECTION 'WebAPI' (Driver = 'http', URL = 'http://host/customers', COLUMNS = 'segment', JSON_PATH = 'items', PAGE_SIZE = 500, PAGINATION_LIMIT_PARAMETER = 'take', PAGINATION_OFFSET_PARAMETER = 'skip')
        QUERY 'Count' FROM CONNECTION WebAPI ( SELECT COUNT(*) AS n FROM WebAPI WHERE segment LIKE '%build%' ) INTO CONSOLE
        """,
        http=pages,
        out=io.StringIO(),
    )
    return j.frames["count"]


@query("SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def parameters(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "orders")
    return run_script(spark, "DECLARE @p; QUERY 'Top' FROM GLOBAL (SELECT max(o_totalprice) AS p FROM orders) INTO PARAMETER (@p) QUERY 'Use' FROM GLOBAL (SELECT o_orderkey FROM orders WHERE o_totalprice = ?) USING PARAMETER @p INTO CONSOLE AFTER Top", out=io.StringIO()).frames["use"]


@query("SELECT 'COLUMN n_name HAS UNIQUE VALUES' AS assertion, count(*) = count(DISTINCT n_name) AS passed FROM nation UNION ALL SELECT 'IT OUTPUTS AT LEAST 30 ROWS', count(*) >= 30 FROM nation UNION ALL SELECT 'COLUMN n_regionkey HAS EXACTLY 5 DISTINCT VALUES', count(DISTINCT n_regionkey) = 5 FROM nation UNION ALL SELECT 'COLUMN n_name HAS NO NULL VALUES', count(*) = count(n_name) FROM nation UNION ALL SELECT 'IT SATISFIES n_nationkey >= 0', bool_and(n_nationkey >= 0) FROM nation")
def row_assertions(spark: SparkSession, d: str) -> DataFrame:
    return assertions.results(table(spark, d, "nation"), "COLUMN n_name HAS UNIQUE VALUES; IT OUTPUTS AT LEAST 30 ROWS; COLUMN n_regionkey HAS EXACTLY 5 DISTINCT VALUES; COLUMN n_name HAS NO NULL VALUES; IT SATISFIES n_nationkey >= 0;")


_PLUGIN = """
import json, sys
for line in sys.stdin:
    q = json.loads(line)
    m, p = q["method"], q["params"]
    r = None
    if m == "get_output_columns":
        r = {"out": ["k", "v"]}
    elif m == "receive":
        rows = p[0] or []
        r = {"rows": [{"source": "", "destination": "", "data": [x["data"][0], x["data"][1] + 1]} for x in rows if x["data"][1] > 0], "logs": []}
    print(json.dumps({"jsonrpc": "2.0", "id": q["id"], "result": r}), flush=True)
"""


#: Adds one to every cell of every row.
_INCREMENT = """
import json, sys
for line in sys.stdin:
    q = json.loads(line)
    r = None
    if q["method"] == "get_output_columns":
        r = {"out": ["a", "b"]}
    elif q["method"] == "receive":
        r = {"rows": [{"source": "", "destination": "out", "data": [c + 1 for c in x["data"]]} for x in q["params"][0] or []], "logs": []}
    print(json.dumps({"jsonrpc": "2.0", "id": q["id"], "result": r}), flush=True)
"""


@query("SELECT c_custkey AS k, c_nationkey + 1 AS v FROM customer WHERE c_nationkey > 0")
def plugin_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return plugins.plugin_transform({"c": c}, ["out"], [sys.executable, "-c", _PLUGIN])["out"]


@query("SELECT n_nationkey + 1 AS a, n_regionkey + 1 AS b FROM nation")
def plugin_map(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    return plugins.plugin_transform({"n": n}, ["out"], [sys.executable, "-c", _INCREMENT])["out"]


@query("SELECT * FROM (VALUES ('Bob', 29.4::double), ('Fred', 27.0)) t(Name, Age)")
def excel_source(spark: SparkSession, d: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        excel.write_excel([["Name", "Age"], ["Bob", 29.4], ["Fred", 27]], f"{folder}/x.xlsx", "Sheet1", "A1:B*")
        return excel.excel_source(spark, f"{folder}/x.xlsx", "Sheet1", "A1:B*")


@query("SELECT * FROM (VALUES (1.0::double, 'a'), (2.0, NULL)) t(id, name)")
def http_source(spark: SparkSession, d: str) -> DataFrame:
    pages = {"offset=0": '{"items":[{"ID":1,"name":"a","x":0}]}', "offset=1": '{"items":[{"id":2}]}'}
    return http_json.http_source(spark, "http://host/api", ["id", "name"], "items", 1, "limit", "offset", transport=lambda url, _: next((v for k, v in pages.items() if url.endswith(k)), '{"items":[]}'))


@query("SELECT '[{\"n\": 25}]' AS text")
def console_json(spark: SparkSession, d: str) -> DataFrame:
    out = io.StringIO()
    outputs.console(transform({"nation": table(spark, d, "nation")}, "AGGREGATE COUNT(1) AS n"), "JSON", out)
    return spark.createDataFrame([(out.getvalue().strip(),)], "text string")


@query("SELECT r_name AS subject, 'Adam' AS name, 'adam@example.com' AS email FROM region")
def email_render(spark: SparkSession, d: str) -> DataFrame:
    made = outputs.mails(table(spark, d, "region").select("r_name"), "Adam <adam@example.com>", "", "Hello", "t", split=True)
    return spark.createDataFrame([(m["rows"][0]["r_name"], m["to"][0]["name"], m["to"][0]["email"]) for m in made], "subject string, name string, email string")


@query("""
SELECT region, round(sum(o_totalprice), 2) AS total, count(*)::double AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey GROUP BY 1
""")
def script_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Several blocks: a shared table, a query, two look-ups, an aggregation, a sink."""
    views(spark, d, "orders", "customer", "nation", "region")
    j = run_script(
        spark,
        """
        GLOBAL 'Init' ( CREATE TABLE totals (region text NOT NULL, total real, orders real); )
        QUERY 'Orders' FROM GLOBAL ( SELECT o_custkey, o_totalprice FROM orders )
        QUERY 'Customers' FROM GLOBAL ( SELECT c_custkey, c_nationkey FROM customer )
        QUERY 'Places' FROM GLOBAL ( SELECT n_nationkey, r_name AS 'region' FROM nation JOIN region ON n_regionkey = r_regionkey )
        TRANSFORM 'WithNation' FROM BLOCK Orders, BLOCK Customers (
            LOOKUP Orders.o_totalprice, Customers.c_nationkey AS k FROM Orders INNER JOIN Customers ON Orders.o_custkey = Customers.c_custkey )
        TRANSFORM 'WithRegion' FROM BLOCK WithNation, BLOCK Places (
            LOOKUP WithNation.o_totalprice, Places.region FROM WithNation INNER JOIN Places ON WithNation.k = Places.n_nationkey )
        TRANSFORM 'Totals' FROM BLOCK WithRegion ( AGGREGATE region, SUM(o_totalprice) AS total, COUNT(1) AS orders GROUP BY region )
        INTO GLOBAL WITH (TABLE = 'totals')
        """,
    )
    return rounded(j.store.table("totals"), "total")


def _sql(name: str, text: str, *tables: str, oracle: str | None = None) -> None:
    """A query of a script over shared tables whose text both engines take."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, *tables)
        return run_script(spark, f"QUERY 'Q' FROM GLOBAL ({text}) INTO CONSOLE WITH (OUTPUT_FORMAT = 'JSON')", hooks=Hooks(sink=lambda *_: True)).frames["q"]

    f.__name__ = name
    query(oracle or text)(f)


_sql("sql_window", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent FROM orders", "orders")
_sql("sql_order_limit", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100", "lineitem")
_sql("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", "customer", "orders")
_sql("sql_union_distinct", "SELECT c_mktsegment AS v FROM customer UNION SELECT o_orderpriority FROM orders", "customer", "orders")
_sql("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
_sql(
    "sql_as_of",
    "SELECT event_id, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS o_orderkey FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY event_id",
    "events",
    "orders",
    oracle="SELECT event_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY event_id",
)
_sql("sql_subquery", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)", "nation", "customer", "supplier")
_sql("integer_division", "SELECT o_orderkey, o_orderkey / 4 AS part FROM orders", "orders")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _made.items() if s}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return agg_group(spark, d)

