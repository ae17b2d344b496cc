"""The fixtures' snapshot family and logs as stored tables: nested Parquet, a directory per day.

Queries on them prune directories by ``partition_day`` and read only the nested fields they name.  The tables are
derived from the driver's parquet by Spark, written to the shared folder and read back with a stated schema.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from daybook.session import new_path
from daybook.sources.fixtures import Fixtures
from daybook.sources.snapshots import LOG_SCHEMA, SNAPSHOT_SCHEMA, latest_snapshot, read_snapshots, write_snapshots


class StoredFixtures(Fixtures):
    def _stored(self, name: str, df: DataFrame, schema: str) -> DataFrame:
        path = new_path(self.spark, name)
        write_snapshots(df, path)
        return read_snapshots(self.spark, path, schema)

    @cached_property
    def pref_history(self) -> DataFrame:
        return self._stored("pref_history", Fixtures.pref_history.func(self), SNAPSHOT_SCHEMA)

    @cached_property
    def pref_latest(self) -> DataFrame:
        return latest_snapshot(self.pref_history, self.p.latest_day)

    @cached_property
    def sent(self) -> DataFrame:
        return self._stored("sent", Fixtures.sent.func(self), LOG_SCHEMA)
