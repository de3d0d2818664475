"""The job's shared tables: immutable versions, swapped at commit, dropped at rollback."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import TYPES, marks, rewrite, statements
from ..runtime.durable import cut

_NAME = r"[`\"\[]?([A-Za-z_]\w*)[`\"\]]?"
#: Appends after which a table's lineage is cut.
APPENDS = 16


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    required: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...]
    df: DataFrame
    appends: int = 0


class GlobalStore:
    """CREATE, DROP, INSERT, DELETE, UPDATE and SELECT over DataFrames; nothing is published before commit()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self._committed: dict[str, Table] = {}

    def commit(self) -> None:
        self._committed = dict(self.tables)

    def rollback(self) -> None:
        for name in self.tables.keys() - self._committed.keys():
            self.spark.catalog.dropTempView(name)
        self.tables = dict(self._committed)
        for t in self.tables.values():
            t.df.createOrReplaceTempView(t.name)

    def __getitem__(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise KeyError(f"unknown table {name}; there are {', '.join(self.tables) or 'none'}")
        return self.tables[name.lower()]

    def table(self, name: str) -> DataFrame:
        return self[name].df

    def _put(self, t: Table) -> None:
        self.tables[t.name.lower()] = t
        t.df.createOrReplaceTempView(t.name)

    def execute(self, sql: str, args: list | None = None) -> DataFrame | None:
        """Runs all statements; gives the last SELECT's rows. Parameters (?) go to the statements in order."""
        out, args = None, list(args or [])
        for s in statements(sql):
            n = marks(s)
            mine, args = (args[:n], args[n:]) if n else ([], args)
            out = self._one(s, mine)
        return out

    def _one(self, sql: str, args: list) -> DataFrame | None:
        if m := re.match(rf"create\s+table\s+(if\s+not\s+exists\s+)?{_NAME}\s*\((.*)\)$", sql, re.I | re.S):
            if m[2].lower() in self.tables:
                if m[1]:
                    return None
                raise ValueError(f"table {m[2]} exists")
            self._put(self._declared(m[2], m[3]))
        elif m := re.match(rf"create\s+table\s+(if\s+not\s+exists\s+)?{_NAME}\s+as\s+(.*)$", sql, re.I | re.S):
            df = self.query(m[3], args)
            self._put(Table(m[2], df.schema, (), (), df))
        elif m := re.match(rf"drop\s+table\s+(if\s+exists\s+)?{_NAME}$", sql, re.I):
            if m[2].lower() not in self.tables and not m[1]:
                raise KeyError(f"unknown table {m[2]}")
            self.tables.pop(m[2].lower(), None)
            self.spark.catalog.dropTempView(m[2])
        elif m := re.match(rf"insert\s+(?:or\s+\w+\s+)?into\s+{_NAME}\s*(?:\(([^()]*)\)\s*)?(values\b.*|select\b.*|with\b.*)$", sql, re.I | re.S):
            body = m[3] if not m[3].lower().startswith("values") else f"SELECT * FROM {m[3]}"
            names = [re.sub(r"[`\"\[\]\s]", "", c) for c in m[2].split(",")] if m[2] else None
            self.append(m[1], self.query(body, args), names)
        elif m := re.match(rf"delete\s+from\s+{_NAME}(?:\s+where\s+(.*))?$", sql, re.I | re.S):
            t = self[m[1]]
            df = t.df.limit(0) if not m[2] else self.spark.sql(f"SELECT * FROM {t.name} WHERE NOT coalesce({rewrite(m[2])}, false)", args=args)
            self._put(replace(t, df=df))
        elif m := re.match(rf"update\s+{_NAME}\s+set\s+(.*?)(?:\s+where\s+(.*))?$", sql, re.I | re.S):
            t = self[m[1]]
            new = dict(re.match(rf"\s*{_NAME}\s*=\s*(.*)$", part, re.S).groups() for part in _split(m[2]))
            new = {k.lower(): rewrite(v) for k, v in new.items()}
            where = f"coalesce({rewrite(m[3])}, false)" if m[3] else "true"
            if args and len(new) > 1 and marks(m[2]):
                raise ValueError("parameters in SET need a single column")
            columns = [f"CASE WHEN {where} THEN CAST({new[f.name.lower()]} AS {f.dataType.simpleString()}) ELSE `{f.name}` END AS `{f.name}`" if f.name.lower() in new else f"`{f.name}`" for f in t.schema]
            order = args[marks(m[2]) :] + args[: marks(m[2])]  # the condition comes first in the rewritten text
            df = self.spark.sql(f"SELECT {', '.join(columns)} FROM {t.name}", args=order * len(new) if args else None)
            self._check(t, df)
            self._put(replace(t, df=df))
        elif re.match(r"(select|with|values)\b", sql, re.I):
            return self.query(sql, args)
        else:
            raise SyntaxError(f"unsupported statement: {sql[:80]}")
        return None

    def query(self, sql: str, args: list | None = None) -> DataFrame:
        for t in self.tables.values():
            t.df.createOrReplaceTempView(t.name)
        return self.spark.sql(rewrite(sql), args=args or None)

    def _declared(self, name: str, body: str) -> Table:
        fields, required, unique = [], [], []
        for part in _split(body):
            words = part.split()
            head = words[0].lower()
            if m := re.match(r"(?:constraint\s+\w+\s+)?(primary\s+key|unique)\s*\((.*)\)", part, re.I):
                columns = tuple(re.sub(r"[`\"\[\]\s]", "", c).lower() for c in m[2].split(","))
                unique.append(columns)
                if m[1].lower().startswith("primary"):
                    required += columns
                continue
            if head in ("foreign", "check", "constraint"):
                continue
            column = re.sub(r"[`\"\[\]]", "", words[0])
            kind = re.sub(r"\(.*", "", words[1].lower()) if len(words) > 1 else "text"
            fields.append(T.StructField(column, T._parse_datatype_string(TYPES.get(kind, "string"))))
            rest = part.lower()
            if "not null" in rest or "primary key" in rest:
                required.append(column.lower())
            if "primary key" in rest or re.search(r"\bunique\b", rest):
                unique.append((column.lower(),))
        schema = T.StructType(fields)
        return Table(name, schema, tuple(required), tuple(unique), self.spark.createDataFrame([], schema))

    def append(self, name: str, rows: DataFrame, names: list[str] | None = None) -> None:
        """Adds rows by name (given names, or those of rows if all are columns of the table, else by position)."""
        t = self[name]
        known = {f.name.lower(): f for f in t.schema}
        if names is None:
            names = rows.columns if all(c.lower() in known for c in rows.columns) else t.schema.names
        if len(names) != len(rows.columns):
            raise ValueError(f"{len(rows.columns)} columns for {len(names)} of {name}")
        if unknown := [n for n in names if n.lower() not in known]:
            raise ValueError(f"unknown columns of {name}: {', '.join(unknown)}")
        at = {n.lower(): c for n, c in zip(names, rows.toDF(*[f"c{i}" for i in range(len(names))]).columns, strict=True)}
        plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
        new = plain.select(*[(F.col(at[f.name.lower()]) if f.name.lower() in at else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema])
        df = t.df.unionByName(new)
        self._check(t, new, t.df)
        appends = t.appends + 1
        if appends % APPENDS == 0:
            df = cut(df)
        self._put(replace(t, df=df, appends=appends))

    def _check(self, t: Table, new: DataFrame, old: DataFrame | None = None) -> None:
        """NOT NULL and unique keys of new rows, among themselves and against those that are there already and hold."""
        if t.required:
            nulls = new.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in dict.fromkeys(t.required)]).first().asDict()
            if bad := [c for c, n in nulls.items() if n]:
                raise ValueError(f"NOT NULL constraint failed: {t.name}.{bad[0]}")
        for key in t.unique:
            columns = [F.col(f"`{c}`") for c in key]
            whole = new
            for c in columns:
                whole = whole.where(c.isNotNull())
            twice = whole.groupBy(*columns).count().where("count > 1").limit(1).count()
            if twice or (old is not None and old.select(*columns).join(whole.select(*columns), list(key), "left_semi").limit(1).count()):
                raise ValueError(f"UNIQUE constraint failed: {t.name}({', '.join(key)})")


def _split(text: str) -> list[str]:
    """Parts between commas outside of parentheses and quotes."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and not depth and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out
