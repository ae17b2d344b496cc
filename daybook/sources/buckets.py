"""Account tables stored in the same buckets, so that windows and joins on the account shuffle nothing.

Each table is Parquet in ``buckets`` files by the hash of the account, sorted by it.  Tables of one ``AccountTables`` have the
same buckets, so a window per account, a semi join or a left join of them reads bucket against bucket.  An account is
in one bucket: tables with a bounded number of rows per account belong here (a day grain, key sets), logs do not.

Joins on the account and further columns (account and day) also stay in their buckets where
``spark.sql.requireAllClusterKeysForCoPartition`` is false; by default Spark shuffles those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class AccountTables:
    def __init__(self, spark: SparkSession, path: str, buckets: int, key: str = "account_id"):
        self.spark, self.path, self.buckets, self.key = spark, path, buckets, key

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Store ``rows`` as table ``name`` below the path and return it as it is read."""
        table = f"daybook_{name}_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, self.key)  # one file per bucket
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{name}").saveAsTable(table)
        return self.spark.table(table)
