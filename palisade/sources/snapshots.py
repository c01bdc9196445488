"""Tables made of parts, read as of one manifest.

Every batch writes a part, a folder of its own that is never changed again. A
manifest lists the parts that make up the table, with their row counts and
ranges. Publishing the next manifest is the only thing that changes the table,
and it is one rename: a reader has all of a version or none of it. Parts of
many batches are merged in the background into larger ones; the replaced
folders stay until :meth:`SnapshotTable.vacuum`, so a running read is not
disturbed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.sources.tables import with_batch_id

FANOUT = 16  # parts of one level that are merged into one of the next
BUCKET = "bucket"


@dataclass(frozen=True)
class Part:
    """One folder of rows of the batches ``first`` to ``last``."""

    path: str
    first: int
    last: int
    rows: int
    level: int = 0
    ranges: dict[str, list] = field(default_factory=dict)  # column: [low, high, nulls]


class Conflict(Exception):
    """The table cannot be changed as asked."""


class SnapshotTable:
    """The table below ``path``.

    ``schema`` is that of the rows without ``batch_id``. ``ranges`` names
    columns (numbers, texts or timestamps) whose lowest and highest values the
    manifest keeps per part. With ``bucket_by``, merged parts hold a folder per
    bucket of that column's hash, and :meth:`read` can be limited to some buckets.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, *,
        ranges: Iterable[str] = (), bucket_by: str | None = None, buckets: int = 64,
    ) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), with_batch_id(schema)
        self.ranges, self.bucket_by, self.buckets = tuple(ranges), bucket_by, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # --- manifests --------------------------------------------------------------

    def _path(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that can still be read, ascending."""
        files, folder = self._files(), self._path("_manifests")
        try:
            found = files.listStatus(folder)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileNotFoundException":
                return []
            raise
        names = [status.getPath().getName() for status in found]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> tuple[int, list[Part]]:
        """A version and its parts; the newest one, or 0 and none."""
        while True:
            known = self.versions()
            if version is None and not known:
                return 0, []
            wanted = known[-1] if version is None else version
            if wanted not in known:
                raise Conflict(f"version {wanted} of {self.path} is not kept any more")
            try:
                stream = self._files().open(self._path("_manifests", f"{wanted:012}.json"))
            except Py4JJavaError:
                if version is None and self.versions()[-1] != wanted:
                    continue  # vacuumed since the listing; there are newer ones
                raise
            try:
                data = bytes(stream.readAllBytes())
            finally:
                stream.close()
            return wanted, [Part(**part) for part in json.loads(data)]

    def _publish(self, version: int, parts: list[Part]) -> bool:
        """False if someone else has published that version before."""
        files = self._files()
        target = self._path("_manifests", f"{version:012}.json")
        draft = self._path("_manifests", f".{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps([asdict(part) for part in parts]).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(
            target.toUri() if target.toUri().getScheme() else files.getUri(),
            self.spark._jsc.hadoopConfiguration(),
        )
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(
            self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1
        )
        options[0] = none
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(target), options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            files.delete(draft, False)
            return False
        return True

    def _change(self, edit: Callable[[list[Part]], list[Part]]) -> int:
        """Apply ``edit`` to the newest parts, again if others were faster."""
        while True:
            version, parts = self.manifest()
            if self._publish(version + 1, edit(parts)):
                return version + 1

    # --- writing ----------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def _store(self, rows: DataFrame, first: int, last: int, level: int) -> Part:
        """Write ``rows`` (with ``batch_id``) into a folder of their own."""
        path = f"parts/{first}-{last}-{uuid.uuid4().hex}"
        names = self.schema.fieldNames()
        if self.bucket_by and level:
            split = rows.select(*names, self._bucket().alias(BUCKET))
            split.repartition(BUCKET).sortWithinPartitions(BUCKET, self.bucket_by).write.partitionBy(
                BUCKET
            ).parquet(f"{self.path}/{path}")
        else:
            rows.select(*names).write.parquet(f"{self.path}/{path}")
        written = self._rows([Part(path, first, last, 0, level)])
        figures = [F.count(F.lit(1))]
        for name in self.ranges:
            value = F.col(name)
            if isinstance(self.schema[name].dataType, T.TimestampType):
                value = F.unix_micros(value)
            figures += [F.min(value), F.max(value), F.count_if(value.isNull())]
        count, *values = written.agg(*figures).first()
        ranges = {name: list(values[3 * i:3 * i + 3]) for i, name in enumerate(self.ranges)}
        return Part(path, first, last, count, level, ranges)

    def write(self, rows: DataFrame, batch_id: int, *, alone: bool = False) -> DataFrame:
        """Add the rows of a batch and return them as stored.

        A batch written again replaces what it wrote before, with or without
        rows. Only the newest batch can be written again after a merge. With
        ``alone`` the batch becomes the whole table.
        """
        part = self._store(
            rows.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id, batch_id, 0
        )

        def edit(parts: list[Part]) -> list[Part]:
            if any(p.first <= batch_id <= p.last and p.level for p in parts):
                raise Conflict(f"batch {batch_id} of {self.path} was merged already")
            kept = [] if alone else [p for p in parts if p.first != batch_id or p.level]
            return [*kept, part] if part.rows else kept

        self._change(edit)
        return self._rows([part]).drop("batch_id")

    def merge(
        self, combine: Callable[[DataFrame], DataFrame] | None = None, *, fanout: int = FANOUT
    ) -> int:
        """Merge parts until no level has ``fanout`` of them; returns how many merges were made.

        The newest batch is left alone, because it may have to be written
        again. ``combine`` may reduce the rows of a merge (which keep the
        highest ``batch_id``), for tables whose rows can be summed up. Merging
        may go on beside writes; if another merge was faster, this one's work
        is dropped.
        """
        merges = 0
        while True:
            _, parts = self.manifest()
            newest = max((p.last for p in parts), default=0)
            group: list[Part] = []
            for level in sorted({p.level for p in parts}):
                ready = sorted(
                    (p for p in parts if p.level == level and p.last < newest), key=lambda p: p.first
                )
                if len(ready) >= fanout:
                    group = ready[:fanout]
                    break
            if not group:
                return merges
            rows = self._rows(group)
            if combine is not None:
                last = F.lit(group[-1].last).cast("long")
                rows = combine(rows).withColumn("batch_id", last)
            merged = self._store(rows, group[0].first, group[-1].last, group[0].level + 1)
            gone = {p.path for p in group}

            def edit(now: list[Part]) -> list[Part]:
                if not gone <= {p.path for p in now}:
                    raise Conflict("merged by another one")
                return [*(p for p in now if p.path not in gone), merged]

            try:
                self._change(edit)
            except Conflict:
                return merges
            merges += 1

    def vacuum(self, *, keep_versions: int = 2, keep_seconds: float = 3600) -> int:
        """Delete what no version needs that is among the newest or still young.

        Folders no manifest knows belong to writes that failed or are going on,
        and go when they are old enough. Returns the number of folders deleted.
        """
        files, known = self._files(), self.versions()
        if not known:
            return 0
        before = (time.time() - keep_seconds) * 1000

        def young(path) -> bool:
            return files.getFileStatus(path).getModificationTime() > before

        kept = [
            v for i, v in enumerate(reversed(known))
            if i < max(1, keep_versions) or young(self._path("_manifests", f"{v:012}.json"))
        ]
        live = {part.path for v in kept for part in self.manifest(v)[1]}
        for version in known:
            if version not in kept:
                files.delete(self._path("_manifests", f"{version:012}.json"), False)
        gone = 0
        for status in files.listStatus(self._path("parts")):
            folder = status.getPath()
            if f"parts/{folder.getName()}" not in live and not young(folder):
                files.delete(folder, True)
                gone += 1
        return gone

    # --- reading ----------------------------------------------------------------

    def _rows(self, parts: list[Part], buckets: Column | None = None) -> DataFrame:
        """The rows of some parts, with ``batch_id``."""
        names = self.schema.fieldNames()
        flat = [p for p in parts if not (self.bucket_by and p.level)]
        frames = []
        if flat:
            rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p.path}" for p in flat))
            frames.append(rows if buckets is None else rows.withColumn(BUCKET, self._bucket()))
        split = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        frames += [
            self.spark.read.schema(split).parquet(f"{self.path}/{p.path}")
            for p in parts if p not in flat
        ]
        if not frames:
            # no rows, known to the optimizer, and no Python worker to say so
            return self.spark.range(1).filter("false").select(
                *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields)
            )
        if buckets is not None:
            frames = [frame.filter(buckets) for frame in frames]
        return reduce(DataFrame.unionAll, (frame.select(*names) for frame in frames))

    def read(
        self, *, version: int | None = None, before: int | None = None,
        keep: Callable[[Part], bool] | None = None, buckets: list[int] | None = None,
    ) -> DataFrame:
        """The rows of one version, by default the newest, with ``batch_id``.

        The parts are chosen now: what is published later changes nothing.
        ``before`` leaves out that batch and later ones, ``keep`` parts it does
        not hold for, ``buckets`` rows of other buckets.
        """
        _, parts = self.manifest(version)
        wanted = [
            p for p in parts if (before is None or p.first < before) and (keep is None or keep(p))
        ]
        rows = self._rows(wanted, None if buckets is None else F.col(BUCKET).isin(buckets))
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall into: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self._bucket().alias(BUCKET)).distinct().collect())

    def newest(self, column: str, limit: int) -> DataFrame:
        """The rows of the parts that can hold the ``limit`` highest values of ``column``.

        Parts whose lowest value is at least t and which together have enough
        rows make t a bound: nothing below it is wanted. Nulls are the lowest.
        """
        _, parts = self.manifest()
        full = sorted((p for p in parts if not p.ranges[column][2]),
                      key=lambda p: p.ranges[column][0], reverse=True)
        total = 0
        for part in full:
            total += part.rows
            if total >= limit:
                bound = part.ranges[column][0]
                reach = [p for p in parts if p.ranges[column][1] is not None and p.ranges[column][1] >= bound]
                return self._rows(reach)
        return self._rows(parts)

    def highest(self, column: str, *, before: int) -> int | None:
        """The highest value of ``column`` in earlier batches, from the manifest alone."""
        _, parts = self.manifest()
        values = [p.ranges[column][1] for p in parts if p.last < before]
        return max((v for v in values if v is not None), default=None)
