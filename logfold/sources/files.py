"""Small operations on folders and files of any store that Spark reaches; no Spark jobs."""

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if there is no such folder."""
    fs, at = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def numbers(spark: SparkSession, folder: str, key: str) -> list[int]:
    """The numbers of the tables ``<folder>/<key>=N``, finished or not."""
    return sorted(int(n.split("=", 1)[1]) for n in names(spark, folder) if n.startswith(f"{key}="))


def last_written(spark: SparkSession, folder: str, key: str) -> int | None:
    """The largest number of a table that Spark marked as written."""
    return next((n for n in reversed(numbers(spark, folder, key)) if "_SUCCESS" in names(spark, f"{folder}/{key}={n}")), None)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if there is one already, which stays as it is."""
    fs, at = _path(spark, path)
    try:
        stream = fs.create(at, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error) or fs.exists(at):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def swap_in(spark: SparkSession, path: str, text: str) -> None:
    """Put a new text into a file by renaming, so that readers see the old or the new one whole."""
    fs, at = _path(spark, path)
    fresh = f"{path}.new"
    remove(spark, fresh)
    create(spark, fresh, text)
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else (
        jvm.FileContext.getFileContext(spark._jsc.hadoopConfiguration()))
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "Options$Rename").OVERWRITE
    context.rename(jvm.Path(fresh), at, options)


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder; none if there is no such folder."""
    fs, at = _path(spark, folder)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
