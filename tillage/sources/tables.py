"""Scans and sinks."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.cleaning import missing_to_null
from tillage.schemas import text_schema


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file systems, so any store that Spark reads works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    if absent := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError("missing inputs: " + ", ".join(absent))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The preferred source that is there."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError("none of these inputs exists: " + ", ".join(paths))


def read_text_table(spark: SparkSession, path: str, ordinal: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column as text, missing tokens null.

    The header alone is read for the names, and types are never inferred. ordinal adds the row's place: (file, offset of
    its split, row number), which orders rows as the files do while each file is still read as many splits. With
    multi_line, for quoted line breaks, a file is one split, since nobody can tell where a record begins inside it.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    names = reader.csv(path).columns
    df = reader.schema(text_schema(names)).option("multiLine", multi_line).csv(path)
    columns = [missing_to_null(F.col(f"`{c}`")).alias(c) for c in names]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return df.select(*columns, *([place.alias(ordinal)] if ordinal else []))


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of CSV files with a header and without a row index; single_file only for small reports."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small report as one file, written by the driver through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name below path, bytes) of each file; of a file alone, the name is empty."""
    p, fs = _path(spark, path)
    root = fs.makeQualified(p).toString()
    found, names = fs.listFiles(p, True), []
    while found.hasNext():
        status = found.next()
        names.append((status.getPath().toString()[len(root) :].lstrip("/"), status.getLen()))
    return names


def _uri(spark: SparkSession, path: str) -> str:
    """A path as Arrow's file systems read it."""
    p, fs = _path(spark, path)
    whole = fs.makeQualified(p).toUri().toString()
    scheme, rest = whole.split(":", 1)
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{'s3' if scheme == 's3a' else scheme}:{rest}"


#: Bytes that a copying task holds at a time.
_PIECE = 8 << 20


def copy_raw(spark: SparkSession, source: str, target: str) -> DataFrame:
    """The bytes of a file or folder as they are; returns (name, bytes, sha256) of each file.

    The list of files is spread over tasks, the larger ones first; each streams its files through memory in pieces,
    writes beside the target's name and renames, so a task that runs again does no harm. A file whose length is not what
    was listed raises, as does an absent source; of an empty folder there are no rows. Stores must be known to Arrow on
    the executors (local and mounted folders, HDFS, S3, GCS).
    """
    require_paths(spark, [source])
    files = _files(spark, source)
    if not files:
        p, fs = _path(spark, target)
        fs.mkdirs(p)
    begin, end = _uri(spark, source), _uri(spark, target)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size in zip(*[c.to_pylist() for c in b.columns[:2]]):
                (fs, root), (to_fs, to_root) = pafs.FileSystem.from_uri(begin), pafs.FileSystem.from_uri(end)
                out = f"{to_root}/{name}".rstrip("/")
                folder, _, last = out.rpartition("/")
                staged_name, sha, done = f"{folder}/_{last}.{uuid.uuid4().hex}", hashlib.sha256(), 0
                to_fs.create_dir(folder, recursive=True)
                with fs.open_input_stream(f"{root}/{name}".rstrip("/"), compression=None) as a, to_fs.open_output_stream(staged_name, compression=None) as z:
                    while piece := a.read(_PIECE):
                        sha.update(piece)
                        z.write(piece)
                        done += len(piece)
                if done != size:
                    to_fs.delete_file(staged_name)
                    raise OSError(f"{name or begin}: {done} bytes of {size}")
                to_fs.move(staged_name, out)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([done]), pa.array([sha.hexdigest()])], names=["name", "bytes", "sha256"])

    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    dealt = [(name, size, i % tasks) for i, (name, size) in enumerate(sorted(files, key=lambda f: -f[1]))]
    listed = spark.createDataFrame(dealt, "name string, bytes long, task int").repartitionById(tasks, "task")
    return cut(listed.mapInArrow(copy, "name string, bytes long, sha256 string"))


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; only a local master may lack the setting."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(d or tempfile.mkdtemp(prefix='tillage-')).rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again: it is computed once, and what follows survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a cut() that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, source: str, target: str) -> None:
    a, fs = _path(spark, source)
    if not fs.rename(a, _path(spark, target)[0]):
        raise OSError(f"could not move {source} to {target}")


#: Written last into a staged folder: what has it is whole.
_WHOLE = "_STAGED"


def _beside(spark: SparkSession, target: str, kind: str) -> list[str]:
    """Folders named target_kind_*, the latest first."""
    p, fs = _path(spark, f"{target.rstrip('/')}_{kind}_*")
    found = fs.globStatus(p) or []
    return [f.getPath().toString() for f in sorted(found, key=lambda f: -f.getModificationTime())]


def recover(spark: SparkSession, target: str) -> str | None:
    """Finish what a crash left undone: if target is absent, a whole staged folder takes its place, else the latest old
    output comes back. Returns which was moved, None if nothing had to be."""
    if exists(spark, target):
        return None
    whole = [f for f in _beside(spark, target, "staging") if exists(spark, f"{f}/{_WHOLE}")]
    for found in [*whole, *_beside(spark, target, "old"), *_beside(spark, target, "backup")][:1]:
        _move(spark, found, target)
        return found
    return None


class staged:  # noqa: N801 - a context manager
    """`with staged(spark, target) as out`: write below out.path, which takes target's place at the end.

    An error inside leaves target as it was and deletes what was staged. The old output goes aside first (to
    target_backup_stamp, which stays, or without a stamp to a name that is deleted at last), then the staged folder is
    renamed. A crash between the two is mended by recover(), which each new staging calls. One writer at a time; renames
    are as atomic as the target's file system makes them.
    """

    def __init__(self, spark: SparkSession, target: str, stamp: str | None = None):
        recover(spark, target)
        self.spark, self.target, self.stamp, self.aside = spark, target.rstrip("/"), stamp, None
        self.id = uuid.uuid4().hex
        self.path = f"{self.target}_staging_{self.id}"

    def __enter__(self) -> staged:
        return self

    def __exit__(self, kind, error, trace) -> None:
        p, fs = _path(self.spark, self.path)
        if kind is not None:
            fs.delete(p, True)
            return
        write_text(self.spark, f"{self.path}/{_WHOLE}", "")
        old = f"{self.target}_backup_{self.stamp}" if self.stamp else f"{self.target}_old_{self.id}"
        if exists(self.spark, self.target):
            _move(self.spark, self.target, old)
            self.aside = old if self.stamp else None
        _move(self.spark, self.path, self.target)
        if not self.stamp:
            gone, fs = _path(self.spark, old)
            fs.delete(gone, True)


def versioned(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Move an existing output aside to path_backup_stamp; the new name, or None if there was nothing."""
    if not exists(spark, path):
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, new = hadoop(path), hadoop(f"{path.rstrip('/')}_backup_{stamp}")
    if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"could not move {path} aside")
    return new.toString()
