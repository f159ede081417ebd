"""Derived tables with versions: readers see whole versions only, writers replace key ranges.

A version is a manifest (one small JSON file) that names, for every segment of the
table, the folder with its rows::

    <table>/data/<commit>/segment=<label>/part-*.parquet
    <table>/manifest/00000000000000000007.json

A commit first writes its rows to a fresh data folder and then moves its manifest in
place under the next number, which fails if another writer was there first.  Until then
nothing refers to the folder, so a crash at any point leaves the last version as it was, and a
reader keeps the files of the version it began with.  Segments that a commit doesn't touch
keep their folders.

``segment`` is an expression over the key that gives a bounded number of labels: a date
or month of a time key, a range of a numeric one, a hash of a text one.  The driver holds the
labels and never rows.  Rows are range-partitioned by (segment, key) before they are written, so
a hot segment is written by many tasks, files are sorted by key and a lookup reads the row
groups whose statistics admit it.

Exactly-once: ``app`` and ``batch`` are kept in the manifest; a batch that was applied is
not applied again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_SEGMENT = "segment"
Combine = Callable[[DataFrame, DataFrame], DataFrame]


class WrittenMeanwhile(RuntimeError):
    """Another writer committed the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    segments: dict[str, str] = field(default_factory=dict)  # label -> folder, relative to the table
    applied: dict[str, int] = field(default_factory=dict)   # app -> last batch
    rows: dict[str, int] = field(default_factory=dict)      # label -> rows


class _Files:
    """The few file operations that a manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Write a file under a name that nobody has yet, whole or not at all; False if the name is taken."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        beside = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf)
        try:
            context.rename(context.makeQualified(beside), context.makeQualified(p), self._no_options())
            return True
        except Exception as e:  # py4j wraps the Java exception
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(beside, False)
            return False

    def _no_options(self):
        return self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def remove(self, folder: str) -> None:
        fs, p = self._at(folder)
        fs.delete(p, True)

    def modified_ms(self, folder: str) -> int:
        fs, p = self._at(folder)
        return fs.getFileStatus(p).getModificationTime()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema, key: list[str], segment: Column | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema = spark.createDataFrame([], schema).schema
        # Without a segment expression the table is one segment: for tables that any commit rewrites as a whole.
        self._segment = F.coalesce(segment.cast("string"), F.lit("none")) if segment is not None else F.lit("all")
        self.files = _Files(spark)

    # --- reading ---------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version by its number, or the newest (0 and empty before the first commit)."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return Version()
            number = numbers[-1]
        return Version(**json.loads(self.files.text(self._manifest(number)))) if number else Version()

    def before(self, app: str, batch: int) -> Version:
        """The newest version that ``app`` committed before ``batch``: what a batch has to start from when it is
        processed again after some of its commits went through (``vacuum`` has to keep it)."""
        for number in reversed(self._numbers()):
            version = self.version(number)
            if version.applied.get(app, -1) < batch:
                return version
        return Version()

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifest/{number:020d}.json"

    def read(self, version: Version | None = None, segments: list[str] | None = None) -> DataFrame:
        """All rows of a version (the newest), or those of some segments."""
        version = version or self.version()
        folders = [f"{self.path}/{f}" for s, f in sorted(version.segments.items()) if segments is None or s in segments]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def lookup(self, **key) -> DataFrame:
        """The rows of one key: only its segment is opened, and of that the row groups that admit the key
        by their statistics (rows are sorted by key) and Bloom filters."""
        one = self.spark.createDataFrame([tuple(key[k] for k in self.key)], StructType([self.schema[k] for k in self.key]))
        rows = self.read(segments=self.touched(one))
        for k in self.key:
            rows = rows.where(F.col(f"`{k}`").eqNullSafe(F.lit(key[k]).cast(self.schema[k].dataType)) if key[k] is None
                              else F.col(f"`{k}`") == F.lit(key[k]).cast(self.schema[k].dataType))
        return rows

    # --- writing ---------------------------------------------------------------

    def _write(self, df: DataFrame) -> tuple[dict[str, str], dict[str, int]]:
        """Rows to a fresh folder; the folders and row counts by segment."""
        commit = f"data/{uuid.uuid4().hex}"
        order = [F.col(_SEGMENT), *[F.col(f"`{k}`") for k in self.key]]
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema], self._segment.alias(_SEGMENT))
        write = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(_SEGMENT)
        for k in self.key[:1]:  # a lookup skips the row groups whose Bloom filter has not the key
            write = write.option(f"parquet.bloom.filter.enabled#{k}", "true")
        write.parquet(f"{self.path}/{commit}")
        folders = {n.split("=", 1)[1]: f"{commit}/{n}" for n in self.files.names(f"{self.path}/{commit}") if n.startswith(f"{_SEGMENT}=")}
        if not folders:
            return {}, {}
        labelled = StructType([*self.schema.fields, StructField(_SEGMENT, StringType())])
        counts = self.spark.read.schema(labelled).parquet(f"{self.path}/{commit}").groupBy(_SEGMENT).count().collect()
        return folders, {r[0]: r[1] for r in counts}

    def _commit(self, base: Version, segments: dict[str, str], rows: dict[str, int], app: str | None, batch: int | None) -> Version:
        applied = base.applied | ({app: batch} if app is not None else {})
        new = Version(base.number + 1, segments, applied, rows)
        if not self.files.put_new(self._manifest(new.number), json.dumps(new.__dict__, sort_keys=True)):
            raise WrittenMeanwhile(f"version {new.number} of {self.path}")
        return new

    def _done(self, base: Version, app: str | None, batch: int | None) -> bool:
        return app is not None and base.applied.get(app, -1) >= batch

    def replace(self, df: DataFrame, *, app: str | None = None, batch: int | None = None) -> Version:
        """A new version with just these rows (a rebuild: the live name serves them from the commit on)."""
        base = self.version()
        if self._done(base, app, batch):
            return base
        folders, rows = self._write(df)
        return self._commit(base, folders, rows, app, batch)

    def touched(self, changes: DataFrame) -> list[str]:
        """Labels of the segments that rows with these keys belong to (bounded by the table's segments)."""
        return [r[0] for r in changes.select(self._segment.alias(_SEGMENT)).distinct().collect()]

    def merge(self, changes: DataFrame, combine: Combine | None = None, *, keys: DataFrame | None = None,
              app: str | None = None, batch: int | None = None) -> Version:
        """A new version in which the segments of the changed keys are rewritten.

        ``combine(old, changes)`` gives a touched segment's rows from its old rows and the
        changes; by default a changed key's row replaces the old one.  ``keys`` are the keys that
        change, where they are more than ``changes`` has (a key without a new row is deleted)."""
        base = self.version()
        if self._done(base, app, batch):
            return base
        keys = changes if keys is None else keys
        labels = self.touched(keys)
        if not labels:
            return self._commit(base, base.segments, base.rows, app, batch) if app is not None else base
        old = self.read(base, labels)
        if combine is None:
            same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in self.key]
            on = same[0]
            for s in same[1:]:
                on = on & s
            kept = old.alias("o").join(keys.select(*self.key).distinct().alias("c"), on, "left_anti")
            new = kept.unionByName(changes.select(*self.schema.names))
        else:
            new = combine(old, changes)
        folders, rows = self._write(new)
        keep = {s: f for s, f in base.segments.items() if s not in labels}
        return self._commit(base, keep | folders, {s: n for s, n in base.rows.items() if s in keep} | rows, app, batch)

    # --- upkeep ----------------------------------------------------------------

    def vacuum(self, keep: int = 2, older_than_ms: int | None = None) -> list[str]:
        """Remove data folders that none of the last ``keep`` versions refers to, and older manifests.
        Folders of commits under way are spared by their age: only those last changed before
        ``older_than_ms`` (epoch milliseconds) go, or, without it, those older than the oldest kept manifest."""
        numbers = self._numbers()
        kept = numbers[-keep:]
        if not kept:
            return []
        limit = older_than_ms if older_than_ms is not None else self.files.modified_ms(self._manifest(kept[0]))
        used = {f.split("/")[1] for n in kept for f in self.version(n).segments.values()}
        gone = []
        for name in self.files.names(f"{self.path}/data"):
            if name not in used and self.files.modified_ms(f"{self.path}/data/{name}") < limit:
                self.files.remove(f"{self.path}/data/{name}")
                gone.append(name)
        for n in numbers[:-keep]:
            self.files.remove(self._manifest(n))
        return gone
