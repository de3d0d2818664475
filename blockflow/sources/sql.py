"""External databases: SQLite files by the standard library, others by JDBC with Spark's own reader and writer."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import bound, marks, statements
from .literal import gathered


class Database:
    """All-or-nothing access: writes wait for commit(). One transaction a job."""

    def query(self, sql: str, args: list) -> DataFrame: ...
    def execute(self, sql: str, args: list) -> None: ...
    def write(self, df: DataFrame, table: str, batch: int, managed: bool) -> None: ...
    def commit(self) -> None: ...
    def rollback(self) -> None: ...


class SQLite(Database):
    def __init__(self, spark: SparkSession, file: str):
        self.spark, self.link = spark, sqlite3.connect(file, isolation_level=None)
        self.link.execute("BEGIN")

    def query(self, sql: str, args: list) -> DataFrame:
        c = self.link.execute(sql, args)
        return gathered(self.spark, map(list, c), [d[0] for d in c.description], whole=True)

    def execute(self, sql: str, args: list) -> None:
        for s in statements(sql):
            n = marks(s)
            self.link.execute(s, args[:n])
            args = args[n:]

    def write(self, df: DataFrame, table: str, batch: int, managed: bool) -> None:
        """A file takes one writer, so rows stream through the driver a partition at a time."""
        names = ", ".join(f'"{c}"' for c in df.columns)
        sql = f'INSERT INTO "{table}" ({names}) VALUES ({", ".join("?" * len(df.columns))})'
        held: list[tuple] = []
        for row in df.toLocalIterator():
            held.append(tuple(row))
            if len(held) == batch:
                self.link.executemany(sql, held)
                held = []
                if not managed:
                    self.link.execute("COMMIT")
                    self.link.execute("BEGIN")
        self.link.executemany(sql, held)
        if not managed:
            self.link.execute("COMMIT")
            self.link.execute("BEGIN")

    def commit(self) -> None:
        self.link.execute("COMMIT")
        self.link.close()

    def rollback(self) -> None:
        self.link.execute("ROLLBACK")
        self.link.close()


class JDBC(Database):
    """Reads are split by PARTITIONCOLUMN, LOWERBOUND, UPPERBOUND and NUMPARTITIONS where given. Writes are held back until commit."""

    def __init__(self, spark: SparkSession, url: str, options: dict[str, str]):
        self.spark, self.url, self.options, self.pending = spark, url, options, []

    def query(self, sql: str, args: list) -> DataFrame:
        sql = bound(sql, args)
        reader = self.spark.read.format("jdbc").option("url", self.url).options(**self.options)
        split = "partitioncolumn" in {k.lower() for k in self.options}
        return (reader.option("dbtable", f"({sql}) q") if split else reader.option("query", sql)).load()

    def execute(self, sql: str, args: list) -> None:
        manager = self.spark.sparkContext._jvm.java.sql.DriverManager
        properties = self.spark.sparkContext._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        link = manager.getConnection(self.url, properties)
        try:
            link.setAutoCommit(False)
            for s in statements(sql):
                ready = link.prepareStatement(s)
                n = marks(s)
                for i, a in enumerate(args[:n]):
                    ready.setObject(i + 1, a)
                args = args[n:]
                ready.execute()
            link.commit()
        except BaseException:
            link.rollback()
            raise
        finally:
            link.close()

    def write(self, df: DataFrame, table: str, batch: int, managed: bool) -> None:
        write = df.write.format("jdbc").option("url", self.url).option("dbtable", table).option("batchsize", batch).options(**self.options).mode("append")
        if managed:
            self.pending.append(write.save)
        else:
            write.save()

    def commit(self) -> None:
        while self.pending:  # what is written goes, so that a retry begins where the failure was
            self.pending[0]()
            self.pending.pop(0)

    def rollback(self) -> None:
        self.pending = []
