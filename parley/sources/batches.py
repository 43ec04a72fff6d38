"""Results that are written batch by batch and survive a stop at any moment, on any store that Spark writes to.

A folder has `rows/<batch>` and, for each batch that is whole, an empty file `done/<batch>`. A batch's name follows from what it
answers and how often that was answered before, so a batch that was stopped between its rows and its entry is written over
when it is run again, and readers take batches with an entry only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.sources import files


class Batches:
    """Batches of rows with a key, below a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "thread_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        where = self._path("")
        self._system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def done(self) -> list[str]:
        """The names of the batches that are whole, in order."""
        where = self._path("done")
        if not self._system.exists(where):
            return []
        return sorted(f.getPath().getName() for f in self._system.listStatus(where))

    def name(self, start: int) -> str:
        """The name of the next batch for what begins at position start: its attempts are numbered."""
        begin = f"b{start:012d}-"
        return f"{begin}{sum(x.startswith(begin) for x in self.done()):06d}"

    def write(self, rows: DataFrame, start: int) -> str:
        """Write rows as the next batch of this start; it counts from when its entry is there."""
        batch = self.name(start)
        rows.write.mode("overwrite").json(f"{self.folder}/rows/{batch}")
        self.commit(batch)
        return batch

    def commit(self, batch: str) -> None:
        self._system.create(self._path(f"done/{batch}"), True).close()

    def read(self, schema: T.StructType | None = None) -> DataFrame | None:
        """The rows of whole batches, for each key those of its latest batch; None if there are none."""
        done = self.done()
        if not done:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.json([f"{self.folder}/rows/{x}" for x in done])
        made = rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), "/rows/b[0-9]+-([0-9]+)/", 1).cast("long"))
        latest = made.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "_batch").alias("_r"))
        return latest.select("_r.*")

    def clear(self) -> None:
        """Forget all batches: first the entries, then the rows."""
        for name in ("done", "rows"):
            self._system.delete(self._path(name), True)


def answered(store: Batches, todo: DataFrame) -> DataFrame:
    """The rows of todo without a finished result in the store."""
    found = store.read()
    return todo if found is None else files.pending(todo, found, store.key)
