import io
import json
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from blockflow import cli
from blockflow.lang.assertions import AssertionFailed
from blockflow.lang.parser import ScriptError
from blockflow.operators.transforms import transform
from blockflow.plans.engine import Hooks, run_script, test_script, validate_script
from blockflow.plans.store import GlobalStore
from blockflow.sources import excel


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_reducers(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double")
    assert rows(transform({"d": df}, "AGGREGATE SUM(x) AS s, AVG(x) AS a, MIN(x) AS i, MAX(x) AS m, COUNT(x) AS c, COUNT(1) AS n, QUANTILE(x, 0.5) AS q, CDF(x, 0) AS p")) == [(1.0, 0.5, 0.0, 1.0, 2.0, 3.0, 0.5, 0.5)]
    assert rows(transform({"d": df.limit(0)}, "AGGREGATE SUM(x) AS s")) == []
    times = spark.createDataFrame([("2018-02-13T01:00:00Z",), ("2018-02-14T11:00:00.5Z",), (None,)], "t string")
    assert rows(transform({"d": times}, "AGGREGATE MIN(t) AS a, MAX(t) AS b")) == [(1518483600.0, 1518606000.0)]
    with pytest.raises(Exception, match="formats are"):
        transform({"d": spark.createDataFrame([("FOO",)], "t string")}, "AGGREGATE MAX(t) AS b").collect()


def test_group_and_errors(spark):
    df = spark.createDataFrame([("HHH", i, i % 2) for i in range(5)], "val string, A long, B long")
    assert rows(transform({"d": df}, "AGGREGATE SUM(a) As Val, b\nGROUP  BY B")) == [(4.0, 1), (6.0, 0)]
    assert rows(transform({"d": df}, "AGGREGATE B AS k GROUP BY k")) == [(0,), (1,)]
    for bad in ("AGGREGATE SUM(A)", "AGGREGATE val, SUM(A) AS s", "AGGREGATE FOO(A) AS s", "AGGREGATE QUANTILE(A) AS s", "SORT A"):
        with pytest.raises(SyntaxError):
            transform({"d": df}, bad)
    with pytest.raises(ValueError):
        transform({"d": df}, "AGGREGATE SUM(nope) AS s")


def zoh(spark, points, a=1, b=5):
    t = lambda s: f"1970-01-01T00:00:{s:02d}Z"
    df = spark.createDataFrame([(t(s), float(v)) for s, v in points], "t string, v double")
    return transform({"d": df}, f"AGGREGATE ZOH(t, v, '{t(a)}', '{t(b)}') AS m").first()[0]


@pytest.mark.parametrize(("points", "mean"), [([(0, 1)], 1), ([(1, 1), (10, 0)], 1), ([(0, 1), (2, 3), (10, 4)], 2.5), ([(0, 1), (1, 2), (2, 3), (10, 4)], 2.75), ([(0, 1), (1, 2), (2, 3), (3, 4)], 3.25), ([(2, 1)], None), ([(0, 1), (1, 2)], 2)])
def test_zoh(spark, points, mean):
    assert zoh(spark, points) == mean


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 20), st.integers(-5, 5), min_size=1, max_size=8))
def test_zoh_is_the_mean_of_the_step_function(spark, points):
    held = {s: points[max(p for p in points if p <= s)] for s in range(1, 5) if any(p <= s for p in points)}
    want = sum(held.values()) / 4 if min(points) <= 1 else None
    assert zoh(spark, points.items()) == (want if want is None else pytest.approx(want))


def test_lookup(spark):
    base = spark.createDataFrame([("1", "A", 2), ("2", "B", 3), ("D", "C", 3), (None, "N", None)], "id string, something string, id2 int")
    other = spark.createDataFrame([("2", "old", 3), ("2", "bob", 3), ("D", "john", 3), (None, "null", None)], "id string, name string, id2 int").coalesce(1)
    body = "LOOKUP b.id, o.name, b.something FROM b {} JOIN o ON b.id = o.id AND o.id2 = b.id2"
    assert rows(transform({"b": base, "o": other}, body.format("INNER"))) == [("2", "bob", "B"), ("D", "john", "C"), (None, "null", "N")]
    assert ("1", None, "A") in rows(transform({"b": base, "o": other}, body.format("OUTER")))
    assert rows(transform({"b": base, "o": other.limit(0)}, body.format("INNER"))) == []
    numbers = spark.createDataFrame([(2, "x")], "id int, name string")
    assert rows(transform({"b": base, "o": numbers}, "LOOKUP o.name FROM b INNER JOIN o ON b.id = o.id")) == [("x",)]
    with pytest.raises(SyntaxError):
        transform({"b": base, "o": other}, "LOOKUP b.id FROM b INNER JOIN o ON b.id = b.id2")


def test_casts(spark):
    df = spark.createDataFrame([("id", "2018-12-01T12:00:00Z", "1", 2.5, True)], "ColA string, ColB string, ColC string, d double, b boolean")
    out = transform({"d": df}, "APPLY ColA, CAST(ColB AS DATETIME) AS t, CAST(colc AS INT), CAST(d AS INT) AS i, CAST(d AS VARCHAR) AS s, CAST(b AS VARCHAR) AS f").select("ColA", "colc", "i", "s", "f").first()
    assert tuple(out) == ("id", 1, 2, "2.500000", "true")
    t = transform({"d": df}, "APPLY CAST(ColB AS DATETIME) AS t")
    assert transform({"d": t}, "APPLY CAST(t AS VARCHAR) AS v, CAST(t AS INT) AS i").first() == ("2018-12-01T12:00:00Z", 1543665600)
    for bad in ("CAST(ColA AS INT)", "CAST(ColA AS DATETIME)"):
        with pytest.raises(Exception):  # noqa: B017
            transform({"d": df}, f"APPLY {bad}").collect()
    with pytest.raises(TypeError):
        transform({"d": df}, "APPLY CAST(d AS DATETIME)")


def test_store_is_all_or_nothing(spark):
    s = GlobalStore(spark)
    s.execute("CREATE TABLE t1 (id INT PRIMARY KEY, n text NOT NULL); INSERT INTO t1 VALUES (1, 'a')")
    s.commit()
    for bad in ("INSERT INTO t1 VALUES (1, 'b')", "INSERT INTO t1 VALUES (2, NULL)", "INSERT INTO t1 (id, x) VALUES (2, 'c')", "SELEC 1", "INSERT INTO nope VALUES (1)"):
        with pytest.raises(Exception):  # noqa: B017
            s.execute(bad)
    s.execute("INSERT INTO t1 SELECT id + 1, 'it''s' FROM t1; UPDATE t1 SET n = 'z' WHERE id = 1; DELETE FROM t1 WHERE id = 2; CREATE TABLE t2 AS SELECT * FROM t1")
    assert rows(s.table("t2")) == [(1, "z")]
    s.rollback()
    assert rows(s.table("t1")) == [(1, "a")] and "t2" not in s.tables


def test_script_rolls_back(spark):
    store = GlobalStore(spark)
    with pytest.raises(ValueError):
        run_script(spark, "EXEC 'A' FROM GLOBAL (CREATE TABLE r1 (id INT PRIMARY KEY); INSERT INTO r1 VALUES (1)) EXEC 'B' FROM GLOBAL (INSERT INTO r1 VALUES (2); INSERT INTO r1 VALUES (1)) AFTER A", store=store)
    assert store.tables == {}


HELLO = """DATA 'Values' ([["Hello, World"],["Hello, World"]]) INTO CONSOLE WITH (COLUMNS = 'Word', OUTPUT_FORMAT = 'JSON') TEST Values WITH ASSERTIONS ({})"""


def test_console_and_assertions(spark):
    out = io.StringIO()
    run_script(spark, HELLO.format("IT OUTPUTS EXACTLY 9 ROWS"), out=out)
    assert json.loads(out.getvalue()) == [{"Word": "Hello, World"}] * 2
    out = io.StringIO()
    test_script(spark, HELLO.format("IT OUTPUTS AT LEAST 2 ROWS; IT OUTPUTS AT MOST 2 ROWS"), out=out)
    with pytest.raises(AssertionFailed):
        test_script(spark, HELLO.format("COLUMN Word HAS UNIQUE VALUES"), out=out)
    validate_script(spark, HELLO.format("COLUMN Word HAS UNIQUE VALUES"), out=out)
    assert out.getvalue() == ""


@pytest.mark.parametrize("text", ["QUERY 'a' FROM GLOBAL (SELECT 1)", "QUERY 'a' FROM CONNECTION x (SELECT 1) INTO CONSOLE", "QUERY 'a' FROM GLOBAL (SELECT 1) INTO CONSOLE AFTER b QUERY 'b' FROM GLOBAL (SELECT 1) INTO CONSOLE AFTER a", "QUERY 'a' FROM GLOBAL (SELECT 1) INTO BLOCK a", "QUERY 'a' FROM GLOBAL (SELECT 1) INTO PARAMETER (@x)", "QUERY 'a' FROM GLOBAL (SELECT 1) INTO CONSOLE WITH (OUTPUT_FORMAT = 'XML')", "CONNECTION 'c' (Driver = 'foo')"])
def test_bad_graphs(spark, text):
    with pytest.raises(ScriptError):
        run_script(spark, text, out=io.StringIO())


def test_includes_templates_hooks_and_cli(spark, tmp_path):
    (tmp_path / "inner.txt").write_text("SET Mode = 'x' DATA 'D' ([[1],[2]]) WITH (COLUMNS = 'n')")
    (tmp_path / "main.txt").write_text("INCLUDE 'inner.txt' TRANSFORM 'T' FROM BLOCK D (AGGREGATE SUM(n) AS {{ .Name }}) INTO CONSOLE WITH (OUTPUT_FORMAT = 'JSON')")
    out, seen = io.StringIO(), []
    run_script(spark, (tmp_path / "main.txt").read_text(), base=tmp_path, params={"Name": "total"}, out=out, hooks=Hooks(sink=lambda name, end, df: seen.append((name, end.kind))))
    assert json.loads(out.getvalue()) == [{"total": 3}] and seen == [("T", "console")]
    assert cli.main(["validate", "--script", str(tmp_path / "main.txt"), "--params", '{"Name": "t"}'], spark) == 0
    assert cli.main(["run", "--script", str(tmp_path / "inner.txt")], spark) == 1


def test_sqlite_excel_and_mail(spark, tmp_path):
    file = tmp_path / "x.db"
    with sqlite3.connect(file) as link:
        link.execute("CREATE TABLE p (ID int, Name text)")
    sent = []
    script = f"""
        CONNECTION 'DB' (Driver = 'sqlite3', ConnectionString = '{file}')
        CONNECTION 'Book' (Driver = 'Excel', File = 'out.xlsx')
        CONNECTION 'Mail' (Driver = 'mandrill', API_KEY = 'k', RECIPIENTS = 'A <a@b.com>', SENDER = 's@b.com', SPLIT = 'true')
        DATA 'D' ([[1, "Bob"], [2, "Eve"], [3, null]]) INTO CONNECTION DB WITH (COLUMNS = 'ID,Name', TABLE = 'p', DROP_NULLS = 'True', ROWS_PER_BATCH = 1)
        QUERY 'Q' FROM CONNECTION DB (SELECT ID, Name FROM p ORDER BY ID) INTO CONNECTION Book, CONNECTION Mail WITH (SHEET = 'S', RANGE = 'A1:B*', COLUMNS = 'Name, ID') AFTER D
    """
    run_script(spark, script, base=tmp_path, mailer=lambda key, m: sent.append((key, m["rows"])))
    assert rows(excel.excel_source(spark, str(tmp_path / "out.xlsx"), "S", "A1:B*", ["n", "i"])) == [("Bob", 1.0), ("Eve", 2.0)]
    assert sent == [("k", [{"ID": 1, "Name": "Bob"}]), ("k", [{"ID": 2, "Name": "Eve"}])]
    with pytest.raises(FileExistsError):
        run_script(spark, script, base=tmp_path, mailer=lambda key, m: None)
    with sqlite3.connect(file) as link:
        assert link.execute("SELECT count(*) FROM p").fetchone() == (2,)


COUNTED = """
import json, os, sys
open(os.environ["STARTS"], "a").write("x")
for line in sys.stdin:
    q = json.loads(line)
    r = None
    if q["method"] == "get_output_columns":
        r = {"even": ["n"], "odd": ["n"]}
    elif q["method"] == "receive":
        r = {"rows": [{"destination": "odd" if x["data"][0] % 2 else "even", "data": x["data"]} for x in q["params"][0] or []]}
    print(json.dumps({"jsonrpc": "2.0", "id": q["id"], "result": r}), flush=True)
"""


def test_children_run_once_for_all_destinations(spark, tmp_path, monkeypatch):
    import sys

    from blockflow.sources.plugins import plugin_transform

    starts = tmp_path / "starts"
    command = ["/usr/bin/env", f"STARTS={starts}", sys.executable, "-c", COUNTED]
    out = plugin_transform({"s": spark.range(6).toDF("n").coalesce(1)}, ["even", "odd"], command)
    for _ in range(2):
        assert rows(out["even"]) == [(0,), (2,), (4,)] and rows(out["odd"]) == [(1,), (3,), (5,)]
    assert starts.read_text() == "xx"  # once for the columns, once for the rows


def test_validate_only_compiles(spark, tmp_path):
    asked = []
    script = f"""
        CONNECTION 'DB' (Driver = 'sqlite3', ConnectionString = '{tmp_path / "never.db"}')
        CONNECTION 'Web' (Driver = 'http', URL = 'http://host', COLUMNS = 'n')
        GLOBAL 'G' (CREATE TABLE made (n int))
        QUERY 'A' FROM CONNECTION DB (SELECT 1 AS n) INTO CONSOLE
        QUERY 'B' FROM CONNECTION Web (SELECT n FROM Web) INTO GLOBAL WITH (TABLE = 'made')
    """
    j = validate_script(spark, script, http=lambda url, h: asked.append(url), out=io.StringIO())
    assert not asked and not (tmp_path / "never.db").exists() and not j.store.tables and not j.frames
    with pytest.raises(ScriptError):
        validate_script(spark, "QUERY 'A' FROM BLOCK nope (SELECT 1) INTO CONSOLE")


def test_tests_make_all_rows(spark):
    script = "DATA 'D' ([[\"1\"],[\"x\"]]) WITH (COLUMNS = 'n') TRANSFORM 'T' FROM BLOCK D (APPLY CAST(n AS INT) AS n) INTO GLOBAL WITH (TABLE = 'none')"
    with pytest.raises(Exception, match="not an integer"):
        test_script(spark, script)


def test_sources_with_several_readers_are_read_once(spark):
    from pyspark.sql import functions as F

    script = "DATA 'D' ([[1],[2]]) WITH (COLUMNS = 'n') QUERY 'A' FROM BLOCK D (SELECT * FROM D) INTO CONSOLE QUERY 'B' FROM BLOCK D (SELECT * FROM D) INTO CONSOLE"
    found = {}
    keep = lambda name, end, df: found.setdefault(name, df.collect()) is not None
    run_script(spark, script, hooks=Hooks(source=lambda name, df: df.withColumn("r", F.expr("uuid()")) if name == "D" else None, sink=keep))
    assert found["A"] == found["B"] and len(found["A"]) == 2


def test_commit_is_tried_again_and_jobs_can_be_cancelled(spark, tmp_path):
    from blockflow.plans.engine import Interrupted, job

    file = tmp_path / "x.db"
    with sqlite3.connect(file) as link:
        link.execute("CREATE TABLE p (n int)")
    script = f"CONNECTION 'DB' (Driver = 'sqlite3', ConnectionString = '{file}') DATA 'D' ([[1],[2]]) INTO CONNECTION DB WITH (COLUMNS = 'n', TABLE = 'p')"
    tries = []

    def break_commit(j):
        def source(name, df):
            db = j.database(j.connections["db"])
            whole = db.commit

            def commit():
                tries.append(1)
                if len(tries) < 3:
                    raise sqlite3.OperationalError("database is locked")
                whole()

            db.commit = commit

        return source

    j = job(spark, script, pause=0.0)
    j.hooks = Hooks(source=break_commit(j))
    j.execute()
    with sqlite3.connect(file) as link:
        assert len(tries) == 3 and link.execute("SELECT count(*) FROM p").fetchone() == (2,)
    j = job(spark, script)
    j.hooks = Hooks(source=lambda name, df: j.cancel())
    with pytest.raises(Interrupted, match="interrupted"):
        j.execute()
    with sqlite3.connect(file) as link:
        assert link.execute("SELECT count(*) FROM p").fetchone() == (2,)


def test_rows_are_gathered_in_chunks(spark):
    from blockflow.sources.literal import frame, gathered

    data = [[1, "a", True, 1.5, "x", None], [2, None, False, 2, 7, None], [None, "it's", None, None, {"k": [1]}, None], [4, "", True, -1e300, None, None], [5, "2", True, 0, "y", None]]
    names = ["i", "s", "b", "f", "m", "none"]
    want = frame(spark, data, names)
    for chunk in (1, 2, 5, 9):
        got = gathered(spark, iter(data), names, chunk=chunk)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
        whole = gathered(spark, iter(data), names, whole=True, chunk=chunk)
        assert whole.dtypes[0] == ("i", "bigint") and [r.i for r in whole.orderBy("i").collect()] == [None, 1, 2, 4, 5]
    assert gathered(spark, iter([]), names).count() == 0


def test_plugin_source_and_sink(spark, tmp_path):
    import sys

    from blockflow.sources.plugins import plugin_sink, plugin_source

    source = """
import json, sys
left = [[1, "a"], [2, "b"], [3, None]]
for line in sys.stdin:
    q = json.loads(line)
    r = ["n", "s"] if q["method"] == "get_output_columns" else {"rows": [left.pop(0)] if left else []} if q["method"] == "receive" else None
    print(json.dumps({"jsonrpc": "2.0", "id": q["id"], "result": r}), flush=True)
"""
    df = plugin_source(spark, [sys.executable, "-c", source])
    assert rows(df) == [(1.0, "a"), (2.0, "b"), (3.0, None)]
    sink = f"""
import json, sys
for line in sys.stdin:
    q = json.loads(line)
    if q["method"] == "receive" and q["params"][0]:
        open({str(tmp_path / "got")!r}, "a").write("".join(json.dumps(r) + "\\n" for r in q["params"][0]))
    print(json.dumps({{"jsonrpc": "2.0", "id": q["id"], "result": None}}), flush=True)
"""
    plugin_sink(df.repartition(2), [sys.executable, "-c", sink])
    assert sorted((tmp_path / "got").read_text().splitlines()) == ['[1.0, "a"]', '[2.0, "b"]', "[3.0, null]"]


def test_bound_arguments():
    from datetime import datetime

    from blockflow.functions.dialect import bound, marks

    text = "SELECT '?', \"?\" FROM t -- ?\nWHERE a = ? AND b = ? AND c IS ? AND d > ?"
    assert marks(text) == 4
    made = bound(text, ["it's ?", 2, None, datetime(2020, 1, 2, 3)])
    assert made.endswith("a = 'it''s ?' AND b = 2 AND c IS NULL AND d > TIMESTAMP '2020-01-02 03:00:00'") and made.startswith("SELECT '?', \"?\" FROM t -- ?")
    with pytest.raises(ValueError):
        bound("a = ?", [])


def test_jdbc(spark):
    """Derby, which Spark brings along, through the script's own words."""
    url = "jdbc:derby:memory:blockflow;create=true"
    head = f"CONNECTION 'DB' (Driver = 'jdbc', ConnectionString = '{url}') "
    run_script(spark, head + "EXEC 'E' FROM CONNECTION DB (CREATE TABLE people (id BIGINT NOT NULL PRIMARY KEY, name VARCHAR(20)); INSERT INTO people VALUES (7, 'what?'))")
    run_script(spark, head + "DATA 'D' ([[1,\"a? \"],[2,\"b\"],[3,\"c\"]]) WITH (COLUMNS = 'id,name') TRANSFORM 'T' FROM BLOCK D (APPLY CAST(id AS INT) AS id, name) INTO CONNECTION DB WITH (TABLE = 'people', ROWS_PER_BATCH = 2)", pause=0.0)
    j = run_script(spark, head + "DECLARE @n; DATA 'P' ([[\"a? \"]]) INTO PARAMETER (@n) WITH (COLUMNS = 'n') QUERY 'Q' FROM CONNECTION DB (SELECT id, name FROM people WHERE name = ?) USING PARAMETER @n INTO CONSOLE AFTER P TRANSFORM 'S' FROM CONNECTION DB (APPLY id, name) INTO CONSOLE WITH (TABLE = 'people')", out=io.StringIO())
    assert rows(j.frames["q"]) == [(1, "a? ")]
    assert rows(j.frames["s"]) == [(1, "a? "), (2, "b"), (3, "c"), (7, "what?")]
    with pytest.raises(Exception):  # noqa: B017  what comes before a failure is not written
        run_script(spark, head + "DATA 'D' ([[9,\"x\"]]) INTO CONNECTION DB WITH (COLUMNS = 'id,name', TABLE = 'people') QUERY 'Q' FROM CONNECTION DB (SELECT nope FROM people) INTO CONSOLE AFTER D", out=io.StringIO(), pause=0.0)
    assert spark.read.format("jdbc").option("url", url).option("dbtable", "people").load().count() == 4


def test_entry_without_the_llm_folder(spark, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "blockflow", tmp_path / "blockflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_group' in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
