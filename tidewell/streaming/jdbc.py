"""Ticks in a database over JDBC: the table, its key and indexes, and upserts by batch.

A batch goes to a staging table in parallel, by Spark's JDBC writer, and from there into the
table by an update and an insert in one transaction: a batch that is run again changes nothing
but the time.  The driver's jar must be on the class path; the SQL is what PostgreSQL (10 on)
and Spark's bundled Derby share.  One writer at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming.sinks import keep_last

CONNECTIONS = 8


def options(dsn: str | None = None) -> dict[str, str]:
    """JDBC options from a `postgres://user:password@host:port/db?...` or `jdbc:` address, by default
    that in the environment's PG_DSN; at most 8 connections write at once."""
    dsn = dsn if dsn is not None else os.environ.get("PG_DSN", "")
    if not dsn.strip():
        raise ValueError("no address: PG_DSN is empty")
    more = {"numPartitions": str(CONNECTIONS)}
    if dsn.startswith("jdbc:"):
        return {"url": dsn, **more}
    parts = urlsplit(dsn)
    if parts.scheme not in ("postgres", "postgresql") or not parts.hostname or len(parts.path) < 2:
        raise ValueError("not an address of a PostgreSQL database")
    query = urlencode(parse_qsl(parts.query))
    out = {"url": f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}" + (f"?{query}" if query else ""), "driver": "org.postgresql.Driver", **more}
    if parts.username:
        out["user"] = unquote(parts.username)
    if parts.password:
        out["password"] = unquote(parts.password)
    return out


class JdbcTicks:
    """The table `win_ticks` of a database."""

    COLUMNS = ("win_idx", "head", "tail", "openwin")

    def __init__(self, spark: SparkSession, dsn: str | None = None, table: str = "win_ticks") -> None:
        self.spark, self.options, self.table = spark, options(dsn), table
        with self._connection():  # a database that cannot be reached is found here
            pass

    def _connection(self):
        jvm, o = self.spark._jvm, self.options
        if "driver" in o:
            jvm.java.lang.Class.forName(o["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        properties = jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in o:
                properties.setProperty(k, o[k])
        return _Closing(jvm.java.sql.DriverManager.getConnection(o["url"], properties))

    def _has(self, connection, kind: str, name: str) -> bool:
        """Whether the table (or an index of it) is there, however the database spells names."""
        meta = connection.getMetaData()
        for spelled in (self.table, self.table.upper()):
            found = meta.getTables(None, None, spelled, None) if kind == "table" else meta.getIndexInfo(None, None, spelled, False, False)
            while found.next():
                if (found.getString("TABLE_NAME" if kind == "table" else "INDEX_NAME") or "").lower() == name.lower():
                    return True
        return False

    def ensure_schema(self) -> None:
        """The table with its unique key (window, head, tail), and indexes by time and by window and time."""
        t = self.table
        wanted = [
            ("table", t, f"CREATE TABLE {t} (id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, ts TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP, win_idx INT NOT NULL, head BIGINT NOT NULL, tail BIGINT NOT NULL, openwin BOOLEAN NOT NULL, CONSTRAINT uq_{t} UNIQUE (win_idx, head, tail))"),
            ("index", f"idx_{t}_ts", f"CREATE INDEX idx_{t}_ts ON {t} (ts)"),
            ("index", f"idx_{t}_win_idx_ts", f"CREATE INDEX idx_{t}_win_idx_ts ON {t} (win_idx, ts)"),
        ]
        with self._connection() as c:
            for kind, name, sql in wanted:
                if not self._has(c, kind, name):
                    c.createStatement().executeUpdate(sql)

    def upsert(self, batch: DataFrame, seq: str | None = None) -> None:
        """Inserts the batch's keys, or sets their flag and time; of rows of one key the last counts."""
        order = F.col(seq).cast("long") if seq else F.monotonically_increasing_id()
        rows = keep_last(batch.select("win_idx", "head", "tail", F.col("open_win").alias("openwin"), order.alias("seq")), ["win_idx", "head", "tail"], "seq").drop("seq")
        staging = f"{self.table}_staging"
        rows.write.format("jdbc").options(**self.options, dbtable=staging).mode("overwrite").save()
        t, q = self.table, '"{}"'.format  # Spark's writer quotes the staging table's names
        same = f"FROM {staging} s WHERE " + " AND ".join(f"s.{q(c)} = {t}.{c}" for c in self.COLUMNS[:3])
        new = " AND ".join(f"{t}.{c} = s.{q(c)}" for c in self.COLUMNS[:3])
        with self._connection() as c:
            c.setAutoCommit(False)
            run = c.createStatement()
            run.executeUpdate(f"UPDATE {t} SET ts = CURRENT_TIMESTAMP, openwin = (SELECT s.{q('openwin')} {same}) WHERE EXISTS (SELECT 1 {same})")
            run.executeUpdate(f"INSERT INTO {t} (ts, {', '.join(self.COLUMNS)}) SELECT CURRENT_TIMESTAMP, {', '.join('s.' + q(x) for x in self.COLUMNS)} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {new})")
            c.commit()

    def read(self) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, dbtable=self.table).load()


class _Closing:
    def __init__(self, connection) -> None:
        self.connection = connection

    def __enter__(self):
        return self.connection

    def __exit__(self, *_) -> None:
        self.connection.close()


def upsert_into(table: JdbcTicks) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`.  Of rows of one key the one of the highest block `number` counts,
    if the batch has that column."""
    return lambda batch, _: table.upsert(batch, "number" if "number" in batch.columns else None)
