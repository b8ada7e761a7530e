"""Folders of the shared store, through Hadoop's file systems: the paths that Spark itself reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if there is no such folder."""
    place, system = _open(spark, path)
    if not system.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(place))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; on file systems with atomic renames it appears as a whole."""
    place, system = _open(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(goal.getParent())
    if system.exists(goal) or not system.rename(place, goal):
        raise OSError(f"cannot move {source} to {target}")


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file unless the target exists; whether it was renamed."""
    place, system = _open(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    if system.exists(goal):
        return False
    try:
        options = spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = spark._sc._gateway.new_array(options, 1)
        none[0] = options.NONE  # fails if the target exists
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(
            system.makeQualified(place), system.makeQualified(goal), none
        )
    except Exception as error:  # the gateway wraps every Java exception in one class
        if system.exists(goal):
            return False
        raise OSError(f"cannot move {source} to {target}") from error
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, system = _open(spark, path)
    out = system.create(place, False)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _open(spark, path)
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    place, system = _open(spark, path)
    system.create(place, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    place, system = _open(spark, path)
    system.delete(place, True)
