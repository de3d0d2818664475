"""Runs scripts: one graph of lazily built DataFrames, an action for each sink, all-or-nothing at the end."""

from __future__ import annotations

import json
import logging
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from ..lang import assertions, options, template
from ..lang.model import Block, End, Script, Value
from ..lang.parser import ScriptError, parse
from ..operators import streams, transforms
from ..sources import excel, http_json, literal, outputs, plugins, sql
from .store import GlobalStore

log = logging.getLogger("blockflow")
MAX_INCLUDES = 8
#: Tries of a commit.
RETRIES = 32
#: The drivers a CONNECTION may name.
DRIVERS = ("sqlite3", "mssql", "postgres", "jdbc", "excel", "http", "mandrill")


class Interrupted(RuntimeError):
    """The job was cancelled."""


@dataclass
class Hooks:
    """Each may give a replacement for what it is shown, or None to keep it."""

    source: Callable[[str, DataFrame], DataFrame | None] = lambda name, df: None
    transform: Callable[[str, DataFrame], DataFrame | None] = lambda name, df: None
    sink: Callable[[str, End, DataFrame], bool | None] = lambda name, end, df: None


@dataclass
class Job:
    """A parsed script with everything around it. mode is run, test or validate."""

    spark: SparkSession
    script: Script
    mode: str = "run"
    base: Path = Path(".")
    params: dict[str, Value] = field(default_factory=dict)
    store: GlobalStore | None = None
    out: TextIO | None = None
    hooks: Hooks = field(default_factory=Hooks)
    http: http_json.Transport = http_json.fetch
    mailer: outputs.Mailer | None = None
    variables: dict[str, object] = field(default_factory=dict)
    #: Seconds by which the pause before another try of a commit grows.
    pause: float = 1.0
    group: str = field(default_factory=lambda: f"blockflow-{uuid.uuid4().hex}")
    cancelled: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self):
        self.settings = {k.upper(): v for k, v in self.params.items()} | self.script.settings
        self.store = self.store or GlobalStore(self.spark)
        self.frames: dict[str, DataFrame | dict[str, DataFrame]] = {}
        self.databases: dict[str, sql.Database] = {}
        self.variables = {name: None for name in self.script.declared}

    # -- preparation

    def prepare(self) -> None:
        self.include(self.script, 0)
        self.settings = {k.upper(): v for k, v in self.params.items()} | self.script.settings
        for b in self.script.of("query", "exec", "transform", "data", "test"):
            values = {k: v for k, v in self.params.items()} | self.settings | b.options
            if b.extern:
                b.body = (self.base / template.render(b.extern, values)).read_text(encoding="utf-8")
            b.body = template.render(b.body, values)
        self.connections = {b.name.lower(): b for b in self.script.of("connection")}
        self.variables = {name: None for name in self.script.declared}
        self.check()

    def include(self, script: Script, depth: int, seen: frozenset[str] = frozenset()) -> None:
        """Merges what included scripts define; a script's own settings win."""
        if depth > MAX_INCLUDES:
            raise ScriptError(f"includes go deeper than {MAX_INCLUDES}")
        for path in script.includes:
            file = str((self.base / template.render(path, self.params | script.settings)).resolve())
            if file in seen:
                raise ScriptError(f"{path} includes itself")
            other = parse(Path(file).read_text(encoding="utf-8"))
            self.include(other, depth + 1, seen | {file})
            script.blocks = other.blocks + script.blocks
            script.declared = list(dict.fromkeys(other.declared + script.declared))
            script.settings = other.settings | script.settings
            script.description = script.description or other.description
        script.includes = []

    def check(self) -> None:
        """Names, shapes and order, before anything runs."""
        nodes: dict[str, Block] = {}
        for b in self.script.of("query", "exec", "transform", "data"):
            if b.name.lower() in nodes:
                raise ScriptError(f"two blocks are named {b.name}")
            nodes[b.name.lower()] = b
        for b in self.connections.values():
            driver = str(b.options.get("DRIVER", "")).lower()
            if driver not in DRIVERS:
                raise ScriptError(f"connection {b.name}: unknown driver {driver or '(none)'}")
        used = set()
        for b in nodes.values():
            if b.kind == "query" and len(b.sources) != 1:
                raise ScriptError(f"{b.name}: a query has one source")
            if b.kind == "exec" and (b.sinks or len(b.sources) != 1 or b.sources[0].kind not in ("connection", "global")):
                raise ScriptError(f"{b.name}: EXEC runs on one connection or GLOBAL and has no INTO")
            for e in [*b.sources, *b.sinks]:
                if e.kind == "connection" and str(e.name).lower() not in self.connections:
                    raise ScriptError(f"{b.name}: unknown connection {e.name}")
            for e in b.sources:
                if e.kind in ("console", "parameter"):
                    raise ScriptError(f"{b.name}: {e.kind.upper()} is no source")
                if e.kind == "block":
                    if str(e.name).lower() not in nodes:
                        raise ScriptError(f"{b.name}: unknown block {e.name}")
                    used.add(str(e.name).lower())
            for e in b.sinks:
                if e.kind == "block":
                    raise ScriptError(f"{b.name}: BLOCK is no destination")
                if e.kind == "console":
                    form = str(options.find("OUTPUT_FORMAT", b.options, self.settings, namespace="console") or "TABLE")
                    if form.upper() not in ("TABLE", "JSON"):
                        raise ScriptError(f"{b.name}: unknown output format {form}")
                for v in e.variables:
                    if v not in self.variables:
                        raise ScriptError(f"{b.name}: {v} is not declared")
            for p in b.parameters:
                if p not in self.variables:
                    raise ScriptError(f"{b.name}: {p} is not declared")
            if b.kind == "transform" and not b.plugin:
                transforms.check(b.body)
        for name, b in nodes.items():
            if b.kind != "exec" and not b.sinks and name not in used:
                raise ScriptError(f"{b.name} has no consumer")
        for b in self.script.of("test"):
            if b.name.lower() not in nodes:
                raise ScriptError(f"TEST of an unknown block {b.name}")
            assertions.parse(b.body)
        self.nodes = nodes
        self.order = self.sort()

    def sort(self) -> list[Block]:
        """Blocks after what they read and what they wait for."""
        done: dict[str, int] = {}
        out: list[Block] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ScriptError(f"cycle: {' -> '.join([*path[path.index(name) :], name])}")
            if name in done:
                return
            b = self.nodes[name]
            for other in [str(e.name).lower() for e in b.sources if e.kind == "block"] + [a.lower() for a in b.after]:
                if other not in self.nodes:
                    raise ScriptError(f"{b.name}: AFTER an unknown block {other}")
                visit(other, (*path, name))
            done[name] = 1
            out.append(b)

        for name in self.nodes:
            visit(name, ())
        return out

    # -- sources

    def option(self, key: str, b: Block, connection: Block | None = None, namespace: str | None = None) -> Value | None:
        return options.find(key, b.options, connection.options if connection else {}, self.settings, namespace=namespace or (connection.name if connection else None))

    def text(self, key: str, b: Block, connection: Block | None = None, default: str = "") -> str:
        v = self.option(key, b, connection)
        return default if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    def database(self, c: Block) -> sql.Database:
        if c.name.lower() not in self.databases:
            driver, where = str(c.options["DRIVER"]).lower(), str(c.options.get("CONNECTIONSTRING", ""))
            extra = {k.lower(): str(v) for k, v in c.options.items() if k not in ("DRIVER", "CONNECTIONSTRING")}
            self.databases[c.name.lower()] = sql.SQLite(self.spark, where) if driver == "sqlite3" else sql.JDBC(self.spark, where if where.startswith("jdbc:") else {"mssql": "jdbc:sqlserver:", "postgres": "jdbc:postgresql:"}[driver] + where, extra)
        return self.databases[c.name.lower()]

    def arguments(self, b: Block) -> list:
        return [self.variables[p] for p in b.parameters]

    def rows_of_connection(self, b: Block, c: Block) -> DataFrame:
        """Everything a connection without SQL gives."""
        driver = str(c.options["DRIVER"]).lower()
        columns = options.names(self.option("COLUMNS", b, c))
        if driver == "excel":
            return excel.excel_source(self.spark, str(self.base / self.text("FILE", b, c)), self.text("SHEET", b, c), self.text("RANGE", b, c), columns or None)
        if driver == "http":
            headers = self.option("HEADERS", b, c)
            return http_json.http_source(self.spark, self.text("URL", b, c), columns, self.text("JSON_PATH", b, c) or None, int(float(self.text("PAGE_SIZE", b, c, "0"))), self.text("PAGINATION_LIMIT_PARAMETER", b, c), self.text("PAGINATION_OFFSET_PARAMETER", b, c), json.loads(str(headers)) if headers else {}, self.http, self.text("FORMAT", b, c, "JSON"))
        raise ScriptError(f"{b.name}: connection {c.name} is no source")

    def read(self, b: Block, e: End) -> tuple[str, DataFrame]:
        """Name and rows of a source of a transform."""
        if e.kind == "block":
            name = str(e.name).lower()
            df = self.frames[name]
            return e.alias or str(e.name), df[b.name.lower()] if isinstance(df, dict) else df
        if e.kind == "global":
            return e.alias or "global", self.store.table(self.text("TABLE", b) or self.text("GLOBAL_TABLE", b))
        c = self.connections[str(e.name).lower()]
        if str(c.options["DRIVER"]).lower() in ("sqlite3", "mssql", "postgres", "jdbc"):
            return e.alias or c.name, self.database(c).query(f"SELECT * FROM {self.text('TABLE', b, c)}", [])
        return e.alias or c.name, self.rows_of_connection(b, c)

    def build(self, b: Block) -> DataFrame | dict[str, DataFrame] | None:
        if b.kind == "data":
            return literal.literal(self.spark, b.body, str(self.option("FORMAT", b) or "JSON_ARRAY"), options.names(self.option("COLUMNS", b)) or None)
        if b.kind == "transform":
            sources = dict(self.read(b, e) for e in b.sources)
            sequential = str(self.option("MULTISOURCE_ORDER", b) or "").upper() == "SEQUENTIAL"
            if b.plugin:
                command = [self.text("EXECUTABLE", b), *json.loads(self.text("ARGS", b, None, "[]"))]
                own = {k: v for k, v in b.options.items() if k not in ("EXECUTABLE", "ARGS", "MULTISOURCE_ORDER")}
                sinks = [e.alias or e.name or e.kind for e in b.sinks] or [x.name.lower() for x in self.nodes.values() if any(s.kind == "block" and str(s.name).lower() == b.name.lower() for s in x.sources)]
                return plugins.plugin_transform(sources, sinks, command, own, sequential)
            return transforms.transform(sources, b.body, sequential)
        e = b.sources[0]
        if e.kind == "block":
            df = self.frames[str(e.name).lower()]
            df.createOrReplaceTempView(str(e.name))
            return self.store.query(b.body, self.arguments(b))
        if e.kind == "global":
            return self.store.query(b.body, self.arguments(b))
        c = self.connections[str(e.name).lower()]
        if str(c.options["DRIVER"]).lower() in ("excel", "http"):
            self.rows_of_connection(b, c).createOrReplaceTempView(str(self.option("STAGING_TABLE", b, c) or c.name))
            return self.store.query(b.body, self.arguments(b))
        return self.database(c).query(b.body, self.arguments(b))

    # -- sinks

    def write(self, b: Block, e: End, df: DataFrame) -> None:
        if self.hooks.sink(b.name, e, df):
            return
        if e.kind == "console":
            outputs.console(df, str(options.find("OUTPUT_FORMAT", b.options, self.settings, namespace="console") or "TABLE"), self.out)
        elif e.kind == "parameter":
            rows = df.take(2)
            if len(rows) > 1:
                raise ScriptError(f"{b.name}: a parameter takes one row")
            if len(df.columns) != len(e.variables):
                raise ScriptError(f"{b.name}: {len(df.columns)} columns for {len(e.variables)} parameters")
            if rows:
                self.variables |= dict(zip(e.variables, rows[0], strict=True))
        elif e.kind == "global":
            self.store.append(self.text("TABLE", b) or self.text("GLOBAL_TABLE", b), streams.drop_nulls(df) if options.truth(self.option("DROP_NULLS", b)) else df)
        else:
            self.write_connection(b, self.connections[str(e.name).lower()], df)

    def write_connection(self, b: Block, c: Block, df: DataFrame) -> None:
        driver = str(c.options["DRIVER"]).lower()
        if driver == "excel":
            columns = options.names(self.option("COLUMNS", b, c))
            df = df.select(*columns) if columns else df
            flag = lambda k: options.truth(self.option(k, b, c))
            excel.write_excel([list(r) for r in df.toLocalIterator()], str(self.base / self.text("FILE", b, c)), self.text("SHEET", b, c), self.text("RANGE", b, c, "A1:*1"), flag("OVERWRITE"), self.text("TEMPLATE", b, c) or None, flag("TRANSPOSE"))
        elif driver == "mandrill":
            messages = outputs.mails(df, self.text("RECIPIENTS", b, c), self.text("SENDER", b, c), self.text("SUBJECT", b, c), self.text("TEMPLATE", b, c), options.truth(self.option("SPLIT", b, c)))
            if self.mailer is None:
                raise ScriptError("no mailer is set up")
            for m in messages:
                self.mailer(self.text("API_KEY", b, c), m)
        elif driver == "http":
            raise ScriptError(f"{b.name}: an http connection is no destination")
        else:
            managed = self.option("MANAGED_TRANSACTION", b, c)
            df = streams.drop_nulls(df) if options.truth(self.option("DROP_NULLS", b, c)) else df
            self.database(c).write(df, self.text("TABLE", b, c), int(float(self.text("ROWS_PER_BATCH", b, c, "500"))), managed is None or options.truth(managed))

    # -- the run

    def cancel(self) -> None:
        """Stops the job from another thread: Spark's tasks are interrupted, nothing is committed."""
        self.cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def _alive(self) -> None:
        if self.cancelled.is_set():
            raise Interrupted("interrupted")

    def readers(self, b: Block) -> int:
        """Sinks and blocks that read a block's rows."""
        return len(b.sinks) + sum(e.kind == "block" and str(e.name).lower() == b.name.lower() for x in self.nodes.values() for e in x.sources)

    def execute(self) -> None:
        """Validation ends with the checks of names, shapes and syntax: no statement runs, nothing is opened or started."""
        self.prepare()
        if self.mode == "validate":
            return
        self.spark.sparkContext.setJobGroup(self.group, self.script.description or "script", interruptOnCancel=True)
        try:
            self._execute()
        except BaseException as e:
            if self.cancelled.is_set() and not isinstance(e, Interrupted):
                raise Interrupted("interrupted") from e
            raise
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                self.spark.sparkContext.setLocalProperty(key, None)

    def _execute(self) -> None:
        shared: list[DataFrame] = []
        tests = {t.name.lower(): t for t in self.script.of("test")}
        try:
            for g in self.script.of("global"):
                self.store.execute(g.body)
            for b in self.order:
                self._alive()
                name = b.name.lower()
                if b.kind == "exec":
                    if self.mode == "run":
                        e = b.sources[0]
                        (self.store.execute if e.kind == "global" else self.database(self.connections[str(e.name).lower()]).execute)(b.body, self.arguments(b))
                    continue
                log.info("building %s", b.name)
                made = self.build(b)
                hook = self.hooks.transform if b.kind == "transform" else self.hooks.source
                if isinstance(made, DataFrame):
                    made = hook(b.name, made) or made
                    if self.readers(b) > 1:  # sources are read once, and all readers see the same rows
                        made = made.persist()
                        shared.append(made)
                self.frames[name] = made
                if self.mode == "test":
                    for df in made.values() if isinstance(made, dict) else [made]:
                        if name in tests:
                            assertions.check(df, b.name, tests[name].body)
                        else:  # rows that no test looks at are still made, so that bad ones are found
                            df.write.format("noop").mode("overwrite").save()
                if self.mode == "run":
                    for e in b.sinks:
                        self.write(b, e, made[e.alias or e.name or e.kind] if isinstance(made, dict) else made)
            self._alive()
            if self.mode == "run":
                for d in self.databases.values():
                    self._retried(d.commit)
                self.store.commit()
            else:
                self._back()
        except BaseException:
            self._back()
            raise
        finally:
            for df in shared:
                df.unpersist()

    def _retried(self, action: Callable[[], None]) -> None:
        """Tries again after one more pause each time; the last failure counts."""
        for n in range(1, RETRIES + 1):
            try:
                return action()
            except Exception as e:
                if n == RETRIES or self.cancelled.is_set():
                    raise
                log.warning("try %d of %d failed: %s", n, RETRIES, e)
                self.cancelled.wait(n * self.pause)

    def _back(self) -> None:
        for d in self.databases.values():
            try:
                d.rollback()
            except Exception as e:  # the others still go back
                log.error("rollback failed: %s", e)
        self.databases = {}
        self.store.rollback()


def job(spark: SparkSession, text: str, **more) -> Job:
    return Job(spark, parse(text), **more)


def run_script(spark: SparkSession, text: str, **more) -> Job:
    """Runs a script; gives the job, whose frames and store hold the results."""
    j = job(spark, text, **more)
    j.execute()
    return j


def test_script(spark: SparkSession, text: str, **more) -> Job:
    return run_script(spark, text, mode="test", **more)


test_script.__test__ = False  # a verb of the language, no test of ours


def validate_script(spark: SparkSession, text: str, **more) -> Job:
    return run_script(spark, text, mode="validate", **more)
