"""Tables that grow by versions: each batch is a folder of its own, readers merge, compaction folds folders together.

Nothing stored is rewritten by a batch. A folder counts once its row is in the log, which is
written last, so a reader sees a batch whole or not at all, and a batch that failed half-way is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOG = "version BIGINT, base BOOLEAN"


class VersionedTable:
    """A table with a key, written in batches of ascending versions.

    Of several versions of a key, the newest counts; columns in ``first`` keep the value of the
    oldest version. One writer at a time for batches, one for compaction; readers and both writers
    may work side by side. A key has at most one row per version, so no group is larger than the number of
    versions since the last compaction.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], first: tuple[str, ...] = ()) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema, self.keys, self.first = StructType.fromDDL(schema), keys, list(first)

    def commits(self) -> tuple[int | None, list[int]]:
        """Version of the newest base, and the batches after it in order; their number is bounded by compaction."""
        self._make_log()
        log = self.spark.read.schema(_LOG).parquet(self._log)
        base = log.where("base").agg(F.max("version")).first()[0]
        after = log.where("NOT base") if base is None else log.where(~F.col("base") & (F.col("version") > base))
        return base, sorted({r.version for r in after.select("version").collect()})

    def append(self, rows: DataFrame, version: int, order: str | None = None) -> bool:
        """Writes a batch; false if the version, or a base that holds it, is there already.

        Of several rows of a key the last by ``order`` counts; without ``order`` keys must be unique.
        """
        base, batches = self.commits()
        if version in batches or (base is not None and version <= base):
            return False
        if batches and version < batches[-1]:
            raise ValueError(f"version {version} comes after version {batches[-1]}")
        others = [f.name for f in self.schema if f.name not in self.keys]
        if order:
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*self.keys, "_row.*")
        self._write(rows, f"batch-{version}")
        self._commit(version, False)
        return True

    def read(self) -> DataFrame:
        """The merged rows. Filters on the key reach the files; straight after a compaction nothing is merged."""
        base, batches = self.commits()
        parts = [] if base is None else [(base, f"base-{base}")]
        return self._merged(parts + [(v, f"batch-{v}") for v in batches])

    def compact(self) -> int | None:
        """Folds what is committed now into one base and returns its version; batches that come meanwhile stay as they are."""
        base, batches = self.commits()
        if not batches:
            return base
        parts = [] if base is None else [(base, f"base-{base}")]
        self._write(self._merged(parts + [(v, f"batch-{v}") for v in batches]), f"base-{batches[-1]}")
        self._commit(batches[-1], True)
        return batches[-1]

    @property
    def _log(self) -> str:
        return f"{self.path}/log"

    def _make_log(self) -> None:
        self.spark.createDataFrame([], _LOG).write.mode("ignore").parquet(self._log)

    def _commit(self, version: int, base: bool) -> None:
        self.spark.createDataFrame([(version, base)], _LOG).coalesce(1).write.mode("append").parquet(self._log)

    def _write(self, rows: DataFrame, folder: str) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode(
            "overwrite").parquet(f"{self.path}/data/{folder}")

    def _merged(self, parts: list[tuple[int, str]]) -> DataFrame:
        names = [f.name for f in self.schema]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        read = [self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").withColumn("_version", F.lit(v))
                for v, folder in parts]
        if len(read) == 1:
            return read[0].drop("_version")
        rows = read[0]
        for more in read[1:]:
            rows = rows.unionByName(more)
        last = [n for n in names if n not in self.keys and n not in self.first]
        picked = [F.max_by(F.struct(*last), "_version").alias("_last")] if last else []
        if self.first:
            picked.append(F.min_by(F.struct(*self.first), "_version").alias("_first"))
        where = {n: F.col(f"_{'first' if n in self.first else 'last'}.{n}") for n in names if n not in self.keys}
        return rows.groupBy(*self.keys).agg(*picked).select(*[where.get(n, F.col(n)).alias(n) for n in names])
