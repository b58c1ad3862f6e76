"""Tables as immutable segments and a versioned manifest.

A segment is a folder of parquet files that is written once. A manifest is one small JSON file that
names the segments that count and holds the state that goes with them (watermarks, the last epoch).
A change writes its segments first and its manifest last, so a reader sees all of a version or
nothing of it, and a job that fails half-way leaves only files that no manifest names. A manifest
is created under its own number and never overwritten: of two writers of one version, one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Segment:
    """``path`` below the store, ``kind`` (rows, removed, ...), the first and last version whose changes it
    holds, its level (0: as it came) and its number of rows."""

    path: str
    kind: str
    first: int
    last: int
    level: int
    rows: int


@dataclass
class Manifest:
    version: int = 0
    segments: list[Segment] = field(default_factory=list)
    state: dict[str, str] = field(default_factory=dict)

    def of(self, kind: str, level: int | None = None) -> list[Segment]:
        return [s for s in self.segments if s.kind == kind and (level is None or s.level == level)]


class VersionConflict(RuntimeError):
    """Another writer has committed this version."""


class SegmentStore:
    """The table below ``base`` (any path that Spark can read and write)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self._conf), path

    def versions(self) -> list[int]:
        """Numbers of the manifests, newest first."""
        fs, folder = self._path("manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)

    def _read(self, version: int) -> Manifest | None:
        fs, path = self._path(f"manifest/v{version:010d}.json")
        stream = fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            raw = json.loads(text)
        except json.JSONDecodeError:  # its writer died: this version was never committed
            return None
        return Manifest(raw["version"], [Segment(**s) for s in raw["segments"]], raw["state"])

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version (default: the newest); an empty one if there is none."""
        for v in self.versions() if version is None else [version]:
            found = self._read(v)
            if found is not None:
                return found
        return Manifest()

    def commit(self, old: Manifest, segments: Sequence[Segment], state: dict[str, str]) -> Manifest:
        """Makes ``segments`` and ``state`` the version after the newest file; ``old`` must still be the newest version."""
        numbers = self.versions()
        if self.manifest().version != old.version:
            raise VersionConflict(f"{self.base}: version {old.version} is not the newest any more")
        new = Manifest(max([old.version, *numbers]) + 1, list(segments), dict(state))
        fs, path = self._path(f"manifest/v{new.version:010d}.json")
        body = json.dumps({"version": new.version, "segments": [vars(s) for s in new.segments], "state": new.state})
        try:
            stream = fs.create(path, False)
        except Exception as error:  # noqa: BLE001 - the JVM's FileAlreadyExistsException
            raise VersionConflict(f"{self.base}: version {new.version} is taken") from error
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        return new

    def write(self, rows: DataFrame, kind: str, version: int, level: int = 0, first: int | None = None,
              partition_by: Sequence[str] = ()) -> Segment:
        """A new segment that no manifest names yet."""
        name = f"{kind}/{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.base}/{name}")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.base}/{name}").count()
        return Segment(name, kind, version if first is None else first, version, level, n)

    def read(self, segments: Sequence[Segment], schema: StructType, version_col: str | None = None,
             where: Column | None = None) -> DataFrame:
        """The rows of the segments; ``version_col`` tells the last version of a row's segment."""
        frames = []
        for s in segments:
            frame = self.spark.read.schema(schema).parquet(f"{self.base}/{s.path}")
            frame = frame if where is None else frame.where(where)
            frames.append(frame if version_col is None else frame.withColumn(version_col, F.lit(s.last).cast("long")))
        if not frames:
            empty = self.spark.createDataFrame([], schema)
            return empty if version_col is None else empty.withColumn(version_col, F.lit(None).cast("long"))
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out
