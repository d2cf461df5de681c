"""A log of batches beside what a stream writes, so that a restart neither repeats nor loses rows.

foreachBatch may run a batch again: after a stop in the middle of it, or between the end of its writes and Spark's own note
that it is done. Each batch writes its outputs and its carried state under its number, over whatever a first try has left
there, and then its entry in the log, by one rename. Readers see batches up to the last entry only; a batch whose
entry is there isn't run again. Numbers come from the stream's checkpoint, which is kept in the same folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """Number of the last whole batch, -1 before the first."""
        path, fs = self._path("log")
        if not fs.exists(path):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=-1)

    def write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def commit(self, batch: int) -> None:
        """The batch is whole; entries before the one before it go."""
        made, fs = self._path("log", f"_{batch}")
        fs.create(made, True).close()
        done, _ = self._path("log", str(batch))
        if not fs.exists(done) and not fs.rename(made, done):
            raise OSError(f"can't write {done}")
        log, _ = self._path("log")
        for s in fs.listStatus(log):
            entry = s.getPath().getName()
            if entry.isdigit() and int(entry) < batch - 1:
                fs.delete(s.getPath(), False)

    def read(self, name: str, schema: str) -> DataFrame:
        """Rows of all whole batches, with their batch."""
        path, fs = self._path(name)
        last = self.last()
        if last < 0 or not fs.exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{name}").where(F.col("batch") <= last)

    def state(self, name: str, schema: str) -> DataFrame:
        """What the last whole batch left to the next one."""
        last = self.last()
        if last < 0 or not self._path(name, f"batch={last}")[1].exists(self._path(name, f"batch={last}")[0]):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={last}")

    def drop_before(self, name: str, batch: int) -> None:
        """States before that of the given batch go; a restart needs the last two at most."""
        path, fs = self._path(name)
        for s in fs.listStatus(path) if fs.exists(path) else []:
            number = s.getPath().getName().removeprefix("batch=")
            if number.isdigit() and int(number) < batch:
                fs.delete(s.getPath(), True)


#: Outputs and states by name; one that is a function is made of what the batch has written before, given by name.
Made = dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]]
Step = Callable[[DataFrame, Ledger], tuple[Made, Made]]


def follow(stream: DataFrame, ledger: Ledger, step: Step, crash: Callable[[int, str], None] | None = None) -> None:
    """Run a stream over what is there: step(batch, ledger) gives outputs and states by name, kept once for each batch.

    crash(batch, where) is called before each write and before the log's entry, for tests of restarts.
    """
    def each(batch: DataFrame, number: int) -> None:
        if number <= ledger.last():
            return
        outputs, states = step(batch, ledger)
        written: dict[str, DataFrame] = {}
        for name, rows in (*outputs.items(), *states.items()):
            if crash:
                crash(number, name)
            rows = rows(written.__getitem__) if callable(rows) else rows
            ledger.write(name, number, rows)
            written[name] = ledger.spark.read.schema(rows.schema).parquet(f"{ledger.folder}/{name}/batch={number}")
        if crash:
            crash(number, "log")
        ledger.commit(number)
        for name in states:
            ledger.drop_before(name, number - 1)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", ledger.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
