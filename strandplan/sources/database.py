"""Projects in a database: read side by side, changed by many rows in one transaction."""

from __future__ import annotations

import uuid
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Rows were changed by someone else after they had been read."""


class ProjectTable:
    """A table of a JDBC database with a key and a column that tells when a row last changed.

    Statements are standard SQL; names are quoted, so they keep their case.
    """

    def __init__(self, spark: SparkSession, url: str, table: str = "Project", key: str = "id", changed: str = "updated_at", **options: str) -> None:
        self.spark, self.url, self.table, self.key, self.changed, self.options = spark, url, f'"{table}"', f'"{key}"', changed, options
        self.key_name = key

    @contextmanager
    def _statement(self):
        """A statement of a transaction of its own, which is undone if anything fails."""
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        connection.setAutoCommit(False)
        try:
            yield connection.createStatement()
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _values(self, statement, sql: str) -> list:
        rows, out = statement.executeQuery(sql), []
        while rows.next():
            out.append(rows.getObject(1))
        return out

    def read(self, parts: int = 1) -> DataFrame:
        """All rows; columns and filters reach the database.

        ``parts`` over one are read side by side: ranges of the key with equally many rows each, whatever its type.
        """
        if parts > 1:
            with self._statement() as statement:
                (count,) = self._values(statement, f"SELECT count(*) FROM {self.table}")
                cuts = [self._values(statement, f"SELECT {self.key} FROM {self.table} ORDER BY {self.key} OFFSET {count * k // parts} ROWS FETCH NEXT 1 ROWS ONLY") for k in range(1, parts) if count * k >= parts]
            ends = [x if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'" for x in dict.fromkeys(v for found in cuts for v in found)]
            ranges = [f"{self.key} >= {a} AND {self.key} < {b}" for a, b in zip(ends, ends[1:])]
            slices = [f"{self.key} < {ends[0]}", *ranges, f"{self.key} >= {ends[-1]}"] if ends else ["1 = 1"]
            return self.spark.read.jdbc(self.url, self.table, predicates=slices, properties=self.options)
        return self.spark.read.jdbc(self.url, self.table, properties=self.options)

    def save(self, rows: DataFrame, deleted: DataFrame | None = None) -> None:
        """Put whole ``rows`` in place of those with their keys, and take the keys of ``deleted`` away, all or nothing.

        Both carry ``seen``, the time of the last change as it was read (null for new rows): if a row has changed or
        gone since, or a new one is there already, nothing is written and :class:`Conflict` is raised.  Tasks write to a
        table of their own, so one that is repeated or lost changes nothing; the move from there is one transaction.
        """
        stage = f'"stage_{uuid.uuid4().hex[:12]}"'
        columns = [c for c in rows.columns if c != "seen"]
        with self._statement() as statement:
            kinds = self._text_sizes(statement)
        taken = ", ".join(f'CAST("{c}" AS VARCHAR({kinds[c]}))' if c in kinds else f'"{c}"' for c in columns)
        names, seen = ", ".join(f'"{c}"' for c in columns), f'"{self.changed}"'
        staged = rows.withColumn("gone", F.lit(0))
        if deleted is not None:
            staged = staged.unionByName(deleted.select(self.key_name, "seen").withColumn("gone", F.lit(1)), allowMissingColumns=True)
        writer = staged.write.mode("errorifexists")
        if self.key_name in kinds:  # a text that may be compared
            writer = writer.option("createTableColumnTypes", f"{self.key_name} VARCHAR({kinds[self.key_name]})")
        try:
            writer.jdbc(self.url, stage, properties=self.options)
            with self._statement() as statement:
                known = f"SELECT 1 FROM {self.table} p WHERE p.{self.key} = s.{self.key}"
                (lost,) = self._values(statement, f'SELECT count(*) FROM {stage} s WHERE (s."seen" IS NULL AND EXISTS ({known})) OR (s."seen" IS NOT NULL AND NOT EXISTS ({known} AND p.{seen} = s."seen"))')
                if lost:
                    raise Conflict(f"{lost} rows have changed since they were read")
                statement.execute(f"DELETE FROM {self.table} WHERE {self.key} IN (SELECT {self.key} FROM {stage})")
                statement.execute(f'INSERT INTO {self.table} ({names}) SELECT {taken} FROM {stage} WHERE "gone" = 0')
        finally:
            with suppress(Py4JJavaError), self._statement() as statement:  # there may be none
                statement.execute(f"DROP TABLE {stage}")

    def _text_sizes(self, statement) -> dict[str, int]:
        """Columns of the table that are texts of bounded length, with that length."""
        about = statement.executeQuery(f"SELECT * FROM {self.table} WHERE 1 = 0").getMetaData()
        return {about.getColumnName(k): about.getPrecision(k) for k in range(1, about.getColumnCount() + 1) if about.getColumnTypeName(k).upper() == "VARCHAR"}
