"""Reliable checkpoints in the folder that the cluster shares, and folders of which readers see one whole version."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The file in a published folder that names its version.
POINTER = "CURRENT"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local folder if all of Spark is this one process, as in tests; else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: lineage ends here, and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _paths(spark: SparkSession, *paths: str):
    jvm = spark._jvm
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *found


def is_published(spark: SparkSession, folder: str) -> bool:
    files, pointer = _paths(spark, posixpath.join(folder, POINTER))
    return files.exists(pointer)


def current_version(spark: SparkSession, folder: str) -> str:
    """The folder of the version that is published in folder; FileNotFoundError if there is none."""
    if not is_published(spark, folder):
        raise FileNotFoundError(f"nothing is published in {folder}")
    name = "".join(x["value"] for x in spark.read.text(posixpath.join(folder, POINTER)).collect())  # one short line
    return posixpath.join(folder, name.strip())


def publish(spark: SparkSession, folder: str, write: Callable[[str], None], check: Callable[[str], None] | None = None, overwrite: bool = False) -> str:
    """Writes a new version into a folder of its own, checks it, and only then makes it the one that current_version gives, by renaming one small pointer file.

    Where writing or checking fails, the new version is deleted, and the one before stays. A version that is
    there already is an error unless overwrite; of writers that overwrite each other, the last to rename wins, whole.
    Former versions stay for those who still read them, until drop_old_versions.
    """
    files, place, pointer = _paths(spark, folder, posixpath.join(folder, POINTER))
    if not overwrite and files.exists(pointer):
        raise FileExistsError(f"{folder} exists")
    name = f"version-{uuid.uuid4().hex}"
    version = posixpath.join(folder, name)
    files.mkdirs(place)
    try:
        write(version)
        if check:
            check(version)
        staged = posixpath.join(folder, f"pointer-{name}")
        _, at = _paths(spark, staged)
        out = files.create(at, True)
        out.write(bytearray(name.encode()))
        out.close()
        _rename(spark, at, pointer, overwrite)
    except BaseException:
        for left in (version, posixpath.join(folder, f"pointer-{name}")):
            files.delete(_paths(spark, left)[1], True)
        raise
    return version


def _rename(spark: SparkSession, at, pointer, overwrite: bool) -> None:
    """In one step; an error if pointer exists, unless overwrite."""
    gateway, hadoop = spark.sparkContext._gateway, spark._jvm.org.apache.hadoop.fs
    option = hadoop.Options.Rename
    how = gateway.new_array(option, 1)
    how[0] = option.OVERWRITE if overwrite else option.NONE
    context = hadoop.FileContext.getFileContext(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(at, pointer, how)


def drop_old_versions(spark: SparkSession, folder: str) -> list[str]:
    """Deletes all versions but the published one, and those being written; gives their names. To be called when nothing reads or writes them."""
    kept = posixpath.basename(current_version(spark, folder))
    files, place = _paths(spark, folder)
    gone = [x.getPath() for x in files.listStatus(place) if x.getPath().getName().startswith("version-") and x.getPath().getName() != kept]
    for path in gone:
        files.delete(path, True)
    return sorted(p.getName() for p in gone)
