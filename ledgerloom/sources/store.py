"""A store of published versions: data are staged, audited, moved, and made current by one pointer file.

Layout below the root: ``staging/<load>/``, ``versions/<load>/{fact,summary,rejects}`` and ``pointers/<number>``, the
largest of which names the live version; a loaded version has its ``metrics``, one JSON document, as well. Readers resolve
the pointer once, so fact and summary always belong together. A pointer is created and never overwritten: each load
notes the number that was live when it began, and of two loads that began on the same version the second to publish
is refused. This rests on a file system that creates a file only where there is none, as HDFS does; on local disks
loads of one driver are kept apart by a lock. The note is the staging folder's lease as well: clean-up spares young leases.
All file operations go through Hadoop's file system API, so the root may lie in any store Spark can write.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summary as summaries
from .schema import FACT, REJECT, STORED_SUMMARY

LEASE = "_lease"
_POINTING = threading.Lock()


class ConcurrentLoadError(RuntimeError):
    """Another load was published first; this one was not."""


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), *parts))

    def _read(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def _pointer(self) -> tuple[int, str | None]:
        """The number and the name of the live version; one that is still being written does not count."""
        fs, at = self._fs(self.path("pointers"))
        numbers = sorted((int(f.getPath().getName()) for f in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
        for number in numbers:
            text = self._read(self.path("pointers", f"{number:012d}"))
            if text.endswith("\n"):
                return number, text.strip()
        return 0, None

    def current(self) -> str | None:
        """The live version's path, None before the first publication."""
        load = self._pointer()[1]
        return load and self.path("versions", load)

    def live(self) -> str:
        """The live version's path; an error before the first publication."""
        path = self.current()
        if path is None:
            raise LookupError(f"nothing was published in {self.root} yet; init() publishes an empty version")
        return path

    def fact(self) -> DataFrame:
        return self.spark.read.schema(FACT).parquet(self.live() + "/fact")

    def summary(self) -> DataFrame:
        return self.spark.read.schema(STORED_SUMMARY).parquet(self.live() + "/summary")

    def rejects(self) -> DataFrame:
        return self.spark.read.schema(REJECT).parquet(self.live() + "/rejects")

    def metrics(self) -> dict:
        """The metrics document of the load that made the live version."""
        return json.loads(self._read(self.live() + "/metrics/part-0.txt"))

    def stage(self) -> str:
        """A fresh staging folder, with a lease that notes the live version's number."""
        staged = self.path("staging", uuid.uuid4().hex)
        self._write(staged + "/" + LEASE, f"{self._pointer()[0]}\n")
        return staged

    def staged(self, staged: str) -> bool:
        """Whether the folder still waits for its publication, under a lease."""
        fs, at = self._fs(staged + "/" + LEASE)
        return fs.exists(at)

    def renew(self, staged: str) -> None:
        """Makes the lease young again; a load does so between its steps."""
        fs, at = self._fs(staged + "/" + LEASE)
        fs.setTimes(at, int(time.time() * 1000), -1)

    def release(self, staged: str) -> None:
        """Gives up the lease of a load that failed: the next clean-up may take its folder."""
        fs, at = self._fs(staged + "/" + LEASE)
        fs.delete(at, False)

    def drop_staging(self, lease_seconds: float = 24 * 3600) -> list[str]:
        """Deletes the staging folders whose load gave up its lease, or has not renewed it for so long; returns their names."""
        fs, at = self._fs(self.path("staging"))
        dropped = []
        for folder in fs.listStatus(at) if fs.exists(at) else []:
            name = folder.getPath().getName()
            lease = self._fs(self.path("staging", name, LEASE))[1]
            if not fs.exists(lease) or fs.getFileStatus(lease).getModificationTime() < (time.time() - lease_seconds) * 1000:
                fs.delete(folder.getPath(), True)
                dropped.append(name)
        return dropped

    def publish(self, staged: str) -> str:
        """Moves a staged folder among the versions, then creates the next pointer; returns the version's path.

        ConcurrentLoadError where another load published since this one was staged. Its data are then no version that any
        reader sees, and go back to the staging folder without a lease.
        """
        load = staged.rstrip("/").rpartition("/")[2]
        began = int(self._read(staged + "/" + LEASE))
        fs, source = self._fs(staged)
        _, target = self._fs(self.path("versions", load))
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot move {staged} to {target}")
        try:
            with _POINTING:
                if self._pointer()[0] != began:
                    raise ConcurrentLoadError(f"another load was published after {load} had begun")
                self._write(self.path("pointers", f"{began + 1:012d}"), load + "\n")
        except Exception as error:
            fs.rename(target, source)
            self.release(staged)
            if "FileAlreadyExists" in str(error):
                raise ConcurrentLoadError(f"another load was published while {load} was") from error
            raise
        self.release(self.path("versions", load))
        return self.path("versions", load)

    def _write(self, path: str, text: str) -> None:
        """A new small file; an error if there is one."""
        fs, at = self._fs(path)
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()

    def init(self, reset: bool = False) -> str:
        """Publishes an empty fact with a zero total, unless a version is live already (``reset``: always)."""
        live = self.current()
        if live is not None and not reset:
            return live
        staged = self.stage()
        write_version(self.spark.createDataFrame([], FACT), self.spark.createDataFrame([], REJECT), staged)
        return self.publish(staged)


def write_clustered(fact: DataFrame, path: str, parts: int | None = None, rows_per_file: int = 5_000_000) -> None:
    """Parquet ordered by user and time: a user's rows lie together, so a filter on the user skips the rest."""
    ranged = fact.repartitionByRange(parts, "usuario_id", "fecha") if parts else fact.repartitionByRange("usuario_id", "fecha")
    ranged.sortWithinPartitions("usuario_id", "fecha", "id").write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def write_version(fact: DataFrame, rejects: DataFrame, staged: str) -> None:
    """Fact, rejects and the summary of the fact as it was written."""
    write_clustered(fact, staged + "/fact")
    rejects.write.option("compression", "zstd").mode("overwrite").parquet(staged + "/rejects")
    written = fact.sparkSession.read.schema(FACT).parquet(staged + "/fact")
    write_summary(written, staged)


def write_summary(fact: DataFrame, staged: str) -> None:
    """The summary with the time it was made at."""
    summaries.type_summary(fact).withColumn("actualizado_en", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(staged + "/summary")


def write_csv(fact: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """The load format of bulk copies: no header, the fact's column order."""
    fact.select(*FACT.names, *(c for c in fact.columns if c not in FACT.names)).write.option("header", "false").option("maxRecordsPerFile", rows_per_file).mode("overwrite").csv(path)


def written_files(df: DataFrame) -> DataFrame:
    """archivo, filas, bytes of each file that ``df`` is read from; files without a row do not appear."""
    found = df.groupBy(F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_size").alias("bytes"))
    return found.agg(F.count("*").alias("filas")).select("archivo", "filas", "bytes")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv`` wrote, in the fact's columns and types; a malformed line is an error."""
    return spark.read.schema(FACT).option("header", "false").option("mode", "FAILFAST").csv(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A raw batch with the declared schema, plus ``file`` and ``row``, its input order."""
    from ..operators.evaluate import with_input_order
    from .schema import RAW

    return with_input_order(spark.read.schema(RAW).parquet(path))


def write_metrics(spark: SparkSession, metrics: dict, staged: str) -> None:
    """A load's metrics as one JSON document, written through the file system without a job."""
    at = spark._jvm.org.apache.hadoop.fs.Path(staged + "/metrics/part-0.txt")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray((json.dumps(metrics, ensure_ascii=False) + "\n").encode()))
    out.close()
