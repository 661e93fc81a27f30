"""Stores of sealed records that several writers and streams may append to.

A store is a folder of data folders and of commits. A writer reads the last commit, seals its records behind the ends of the chains of
that version, writes them into a data folder of its own, and then makes the next commit, which names that folder. A commit is made by
an operation that fails where the name is taken, so of two writers that began at one version the second is refused and its
records are not part of the store: a chain can't fork. Readers see committed folders only.

A commit also holds the batch that it came from, so a batch that a stream replays changes nothing.

Such an operation is a hard link on local and mounted folders, and a rename on HDFS; object stores without one need a lock outside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.operators import chain
from tessera.session import materialised

COMMIT = "version long, data string, schema string, stream string, batch long"


class Conflict(RuntimeError):
    """Another writer has appended to the store since its state was read."""


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def commits(spark: SparkSession, path: str) -> list:
    """The commits in order; one small file each."""
    files, place = _place(spark, f"{path}/commits")
    if not files.exists(place):
        return []
    return spark.read.schema(COMMIT).option("mode", "FAILFAST").option("pathGlobFilter", "[0-9]*").json(f"{path}/commits").orderBy("version").collect()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The records of a store, as of a version or the last. A store without commits can't be read."""
    held = [c for c in commits(spark, path) if version is None or c.version <= version]
    if not held:
        raise ValueError(f"no commit in {path}")
    schema = T.StructType.fromJson(json.loads(held[-1].schema))
    return spark.read.schema(schema).option("mode", "FAILFAST").json([f"{path}/data/{c.data}" for c in held])


def _commit(spark: SparkSession, path: str, version: int, marker: dict) -> bool:
    """Makes the commit, or tells that another has this version already. The marker is complete before it has its name."""
    jvm = spark.sparkContext._jvm
    name, draft = f"{path}/commits/{version:020d}", f"{path}/commits/_{uuid.uuid4().hex}"
    files, place = _place(spark, draft)
    out = files.create(place, False)
    out.write(json.dumps(marker).encode())
    out.close()
    try:
        if files.getScheme() != "file":
            return files.rename(place, _place(spark, name)[1])
        local = lambda p: jvm.java.nio.file.Paths.get(files.makeQualified(_place(spark, p)[1]).toUri())
        try:
            jvm.java.nio.file.Files.createLink(local(name), local(draft))
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True
    finally:
        files.delete(place, False)


def append(payloads: DataFrame, path: str, chain_column: str, order: str, signer: tuple[str, bytes] | None = None, expected: int | None = None, batch: tuple[str, int] | None = None, attempts: int = 1) -> int:
    """Seals records (chain, order, payload) behind the ends of a store's chains, appends them, and returns the store's version.

    ``expected``: the version that the caller has seen; Conflict is raised where the store has moved on. Without it the last version is
    read, and where another writer is faster, the records are sealed again, ``attempts`` times in all. ``batch`` (stream, number) that
    the store holds already changes nothing. The data of a refused append are deleted.
    """
    spark = payloads.sparkSession
    for left in range(attempts - 1, -1, -1):
        held = commits(spark, path)
        head = held[-1].version if held else 0
        done = [c.version for c in held if batch and (c.stream, c.batch) == batch]
        if done:
            return done[0]
        if expected is not None and expected != head:
            raise Conflict(f"{path} is at version {head}, not at {expected}")
        after = None
        if held:
            ends = read(spark, path, head).groupBy(chain_column).agg(F.max_by(F.struct("sequence", "digest"), "sequence").alias("end"))
            after = materialised(ends.select(chain_column, "end.sequence", "end.digest"))
        data = uuid.uuid4().hex
        sealed = chain.seal(payloads, chain_column, order, "payload", signer=signer, after=after)
        sealed.write.json(f"{path}/data/{data}")
        marker = {"version": head + 1, "data": data, "schema": sealed.schema.json(), "stream": batch[0] if batch else None, "batch": batch[1] if batch else None}
        if _commit(spark, path, head + 1, marker):
            return head + 1
        files, place = _place(spark, f"{path}/data/{data}")
        files.delete(place, True)
        if not left:
            raise Conflict(f"another writer has made version {head + 1} of {path}")
    raise ValueError("attempts must be at least 1")


def batches(stream: str, path: str, chain_column: str, order: str, signer: tuple[str, bytes] | None = None, attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends each batch of a stream once, however often it is replayed."""

    def write(rows: DataFrame, number: int) -> None:
        append(rows, path, chain_column, order, signer, batch=(stream, number), attempts=attempts)

    return write
