"""A store of many addresses that changes as one.

A commit writes its rows to a folder of its own, then a manifest: a table that says for
every address of the store which commit holds it.  What makes the new version is one
small file that names the manifest, moved into place under the next number.  Readers
follow the highest number, so a writer that breaks off anywhere leaves the old version
as it was.  The move fails where the number exists: of two writers that started from one
version the second is refused, and nothing of it can be read.

Addresses and rows stay in tables; only the name of a manifest passes the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMIT = "commit"


class ConcurrentCommit(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class RefusedRows(ValueError):
    """Rows break a contract; ``counts`` says how many have which value, and no version was made."""

    def __init__(self, root: str, counts: dict[tuple[str, str], int]) -> None:
        super().__init__(f"{root} takes no rows with " + ", ".join(f"{c} {v!r} ({n} rows)" for (c, v), n in counts.items()))
        self.counts = counts


def _files(spark: SparkSession, root: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    return hadoop, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all versions, oldest first."""
    hadoop, fs = _files(spark, root)
    folder = hadoop.Path(f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """(address, commit) of a version, the newest unless given; None for an empty store."""
    known = versions(spark, root)
    if version is None and not known:
        return None
    version = known[-1] if version is None else version
    if version not in known:
        raise KeyError(f"{root} has no version {version}")
    name = spark.read.text(f"{root}/versions/{version:012d}").first()[0]
    return spark.read.parquet(f"{root}/manifests/{name}")


def _publish(spark: SparkSession, root: str, version: int, name: str) -> None:
    hadoop, fs = _files(spark, root)
    fresh = hadoop.Path(f"{root}/pending/{name}")
    out = fs.create(fresh)
    out.write(name.encode())
    out.close()
    target = hadoop.Path(f"{root}/versions/{version:012d}")
    fs.mkdirs(target.getParent())
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, none)
    except Exception as error:  # py4j wraps what the file system throws
        if "FileAlreadyExists" in str(error):
            raise ConcurrentCommit(f"version {version} of {root} exists; read it and try again") from error
        raise


def commit(
    rows: DataFrame, root: str, address: Sequence[str], replace: bool = False, base: int | None = None, refuse: Mapping[str, Sequence[str]] | None = None
) -> int:
    """Add the addresses of ``rows`` in one step and return the number of the new version.

    Addresses that the store holds are refused, or replaced with ``replace``; all others
    stay.  ``base`` is the version that the rows were made from, the newest unless given:
    if it is not the newest any more, the commit fails.  An address must not be null in
    any part, for a folder is named by it.

    ``refuse`` names values of columns that no row may have, such as
    ``{"status": ["error", "no recording"]}``.  They are counted in the very pass that
    writes the rows; where there are any, ``RefusedRows`` is raised before a version is
    made.
    """
    spark, address = rows.sparkSession, list(address)
    known = versions(spark, root)
    base = (known[-1] if known else 0) if base is None else base
    if known and base != known[-1]:
        raise ConcurrentCommit(f"{root} is at version {known[-1]}, the rows were made from {base}")
    name = uuid.uuid4().hex
    folder = f"{root}/data/{COMMIT}={name}"
    broken = [(c, v) for c, values in (refuse or {}).items() for v in values]
    seen = Observation()
    counted = rows.observe(seen, *[F.count_if(F.col(c) == v).alias(f"n{i}") for i, (c, v) in enumerate(broken)]) if broken else rows
    counted.write.partitionBy(*address).parquet(folder)
    if broken:
        counts = {b: seen.get.get(f"n{i}", 0) for i, b in enumerate(broken)}
        if any(counts.values()):
            raise RefusedRows(root, {b: n for b, n in counts.items() if n})
    kinds = {a: rows.schema[a].dataType for a in address}
    written = spark.read.schema(rows.schema).parquet(folder).select(*[F.col(a).cast(kinds[a]) for a in address]).distinct()
    if not written.where(" OR ".join(f"`{a}` IS NULL" for a in address)).isEmpty():
        raise ValueError("an address has a null part")
    entries = written.withColumn(COMMIT, F.lit(name))
    before = manifest(spark, root, base) if base else None
    if before is not None:
        clash = before.join(written, address, "left_semi")
        if not replace and not clash.isEmpty():
            raise FileExistsError(f"{root} already holds {clash.first().asDict()}")
        entries = entries.unionByName(before.join(written, address, "left_anti"))
    entries.write.parquet(f"{root}/manifests/{name}")
    _publish(spark, root, base + 1, name)
    return base + 1


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of all addresses of a version, the newest unless given.

    Folders are named by commit and address, so the join with the manifest prunes what
    the version does not hold, and filters on the address prune folders as usual.
    """
    held = manifest(spark, root, version)
    if held is None:
        raise FileNotFoundError(f"{root} holds no version")
    address = [c for c in held.columns if c != COMMIT]
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/data")
    except PySparkException as error:
        raise FileNotFoundError(f"{root} has no data") from error
    rows = rows.withColumns({a: F.col(a).cast(held.schema[a].dataType) for a in address})
    return rows.join(held, [*address, COMMIT], "left_semi").drop(COMMIT)
