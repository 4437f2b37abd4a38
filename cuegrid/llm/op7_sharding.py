"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder of immutable runs (folders of Parquet shards) and a series of manifests. ``append`` writes
an arrival as a run of small shards, as the scan deals them, and commits. ``compact`` merges FANOUT runs of one
size tier into one run of files of about the target size, until no tier is full. Merging reads whole files, packed
by their bytes into one partition for each new file: no shuffle.

A manifest version lists all live runs. A writer publishes it in these steps: it writes a complete draft under a
name of its own, deletes all other drafts of the same version, sees that the version is not there, and renames its
draft. The rename is the one step that commits; a reader sees an old version or the new one, never a part. Of two
writers of one version at most one gets so far: whoever comes later to delete takes the draft from the other, or
finds the version there. A writer whose draft is gone, or that finds the version, reads the newest manifest and
tries again. A writer that is lost at any step leaves a draft at most, which the next one deletes. Runs that no kept
version names (also those of lost or failed jobs) are deleted by ``vacuum``.

Defined cases: an empty arrival commits nothing; nulls, empty and very long texts and repeated rows are kept as
they are, each row once; columns are those of the arrival (all arrivals of a store must have the same, of any
names: where ``read`` adds a name that a column has, it appends an underscore); an empty store reads as no rows.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuegrid.llm.common import scratch, unused

TARGET_BYTES = 128 << 20
#: Runs under this size are of tier 0; each tier is FANOUT times the one before.
BASE_BYTES = 16 << 20
FANOUT = 4


@dataclass(frozen=True)
class Run:
    name: str
    path: str
    rows: int
    bytes: int
    merged_from: int = 1


def tier_of(size: int, base: int = BASE_BYTES, fanout: int = FANOUT) -> int:
    return 0 if size < base else 1 + int(math.log(size / base, fanout) + 1e-9)


class Conflict(Exception):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, base: int = BASE_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.base, self.fanout = spark, root.rstrip("/"), target, base, fanout
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # --- manifests ---

    def versions(self) -> list[int]:
        return sorted(int(x[1:-5]) for x in self._list("manifest") if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """(version, runs) of the newest or the given version; version 0 is the empty store."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if not version:
            return 0, []
        stream = self._fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Run(**x) for x in json.loads(text)["runs"]]

    def draft(self, version: int, runs: list[Run]) -> str:
        """Writes a complete draft of a version; its name."""
        name = f"draft/v{version:08d}-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path("draft"))
        try:
            stream = self._fs.create(self._path(name), False)
            stream.write(bytearray(json.dumps({"version": version, "runs": [asdict(x) for x in runs]}).encode()))
            stream.close()
        except Py4JJavaError as lost:
            if self._fs.exists(self._path(name)):
                raise
            raise Conflict(str(version)) from lost  # another writer has deleted it
        return name

    def publish(self, version: int, draft: str) -> int:
        """Makes a draft the version, or raises Conflict."""
        for other in self._list("draft"):
            if other.startswith(f"v{version:08d}-") and f"draft/{other}" != draft:
                self._fs.delete(self._path(f"draft/{other}"), False)
        self._fs.mkdirs(self._path("manifest"))
        if self.manifest_exists(version):
            self._fs.delete(self._path(draft), False)
            raise Conflict(str(version))
        try:
            renamed = self._fs.rename(self._path(draft), self._path(f"manifest/v{version:08d}.json"))
        except Py4JJavaError as gone:  # another writer has deleted the draft
            raise Conflict(str(version)) from gone
        if not renamed:
            raise Conflict(str(version))
        return version

    def manifest_exists(self, version: int) -> bool:
        return bool(self._fs.exists(self._path(f"manifest/v{version:08d}.json")))

    def commit(self, after: int, runs: list[Run]) -> int:
        """Publishes version ``after`` + 1, or raises Conflict."""
        return self.publish(after + 1, self.draft(after + 1, runs))

    def _publish(self, change, tries: int = 20) -> int | None:
        """Commits ``change(runs)`` on top of the newest version; None if the change no longer applies."""
        for k in range(tries):
            if k:
                time.sleep(random.uniform(0, min(0.05 * 2**k, 5)))
            version, runs = self.manifest()
            new = change(runs)
            if new is None:
                return None
            try:
                return self.commit(version, new)
            except Conflict:
                continue
        raise Conflict("too many writers")

    # --- runs ---

    def _write(self, df: DataFrame, name: str, merged: int = 1) -> Run:
        path = f"{self.root}/runs/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        return Run(name, path, rows, int(self._fs.getContentSummary(self._hadoop.Path(path)).getLength()), merged)

    def append(self, arrival: DataFrame, name: str) -> int | None:
        """The new version, or None for an empty arrival."""
        run = self._write(arrival, name)
        return self._publish(lambda runs: [*runs, run]) if run.rows else None

    def full_tier(self, runs: list[Run]) -> list[Run]:
        """The oldest FANOUT runs of the lowest tier that has so many."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(tier_of(r.bytes, self.base, self.fanout), []).append(r)
        return next((tiers[t][: self.fanout] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merges until no tier is full; the number of merges."""
        merges = 0
        while old := self.full_tier(self.manifest()[1]):
            # Spark packs files into partitions by their bytes; the settings hold for this merge alone.
            session = self.spark.newSession()
            for key, value in (("maxPartitionBytes", self.target), ("minPartitionNum", 1), ("openCostInBytes", 1)):
                session.conf.set(f"spark.sql.files.{key}", str(value))
            new = self._write(session.read.parquet(*(r.path for r in old)), "+".join((old[0].name.split("+")[0], old[-1].name.split("+")[-1])), sum(r.merged_from for r in old))
            if new.rows != sum(r.rows for r in old):
                raise RuntimeError(f"merged {new.rows} rows of {sum(r.rows for r in old)}")
            gone = {r.path for r in old}
            done = self._publish(lambda runs: [*(r for r in runs if r.path not in gone), new] if gone <= {r.path for r in runs} else None)  # noqa: B023
            merges += done is not None
        return merges

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest ``keep`` versions, and runs that no kept version names; only for a time
        when no job writes."""
        found = self.versions()
        for v in found[:-keep]:
            self._fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        live = {r.path.rsplit("/", 1)[1] for v in found[-keep:] for r in self.manifest(v)[1]}
        dead = [x for x in self._list("runs") if x not in live]
        for x in dead:
            self._fs.delete(self._path(f"runs/{x}"), True)
        return len(dead)

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """All rows of a version, with the run, tier and shard that hold them and the version."""
        version, runs = self.manifest(version)
        names = [f.name for f in schema.fields]
        added = []
        for name in ("run", "tier", "shard", "version"):
            added.append(unused(name, [*names, *added]))
        kinds = (T.StringType(), T.IntegerType(), T.StringType(), T.IntegerType())
        out = self.spark.createDataFrame([], T.StructType([*schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds, strict=True))]))
        for r in runs:
            df = self.spark.read.schema(schema).parquet(r.path)
            shard = F.regexp_extract(df.metadataColumn("_metadata")["file_name"], r"^part-\d+", 0)
            place = (F.lit(r.name), F.lit(tier_of(r.bytes, self.base, self.fanout)), shard, F.lit(version))
            out = out.unionAll(df.select(*(df[n] for n in names), *(c.alias(n) for c, n in zip(place, added, strict=True))))
        return out


ARRIVALS = 8


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` arrive in eight parts, by a hash of doc_id; after each the store is compacted. Returns
    where the newest version holds each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, scratch(spark, "store"))
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % ARRIVALS, F.lit(0))
    for k in range(ARRIVALS):
        store.append(docs.where(part == k), f"a{k}")
        if store.compact():
            store.vacuum()
    return store.read(docs.schema).select("doc_id", "run", "tier", "shard", "version", F.length("text").cast("long").alias("text_chars"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
