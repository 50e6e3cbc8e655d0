"""Operator 1: sharding by size-tiered compaction, in DataFrame functions only.

A store is a folder: immutable shard files below ``data/``, immutable lists of shards below
``lists/`` and numbered manifests below ``manifest/``. An append writes one small shard for
each slice of the arrivals, without a shuffle. Compaction takes shards below the target
size, those of a size tier (powers of ``fan`` below the target) being a run; a tier with
``fan`` shards or more is merged: the scan packs its files into partitions of the target
size and each partition is written as one file, so no row crosses the network and a task
never holds more than it streams. A tier that the scan can't pack further stays as it is.

A manifest names a schema and lists, each of at most LIST_SHARDS shards; a commit writes
lists for the shards that changed and keeps the others by name, and compaction reads only
lists that hold small shards, so metadata work follows what is new. Every step is committed
by writing the next manifest under a hidden name and renaming it to its number without
overwriting, which fails if the number exists: of two writers one commits and the other
raises. Readers see a whole version or its predecessor. On file systems whose rename isn't
atomic (object stores that copy) only one writer at a time is safe. Old shards stay for
readers of old versions until ``vacuum``.

Rows: all rows and columns are kept as they are, nulls, repeated rows and clashing
names in nested columns included; only top-level names must differ, as in any Parquet
file. An append may lack columns, which are null then, or bring new ones, which are null in
older shards; one that gives a column another type, or names that differ in case only,
raises and commits nothing. An empty append commits a version without new shards. Order
within a shard has no meaning.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vectorscape.llm.shared import new_path, table

TARGET_BYTES, FAN = 128 << 20, 4
#: Shards that one list names, and lists far shorter than that which a commit leaves.
LIST_SHARDS, SHORT_LISTS = 4096, 64
#: Appends that the files of a table are dealt to.
ARRIVALS = 4


class ShardStore:
    """A versioned set of shards at ``path``, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        if target_bytes < 1 or fan < 2:
            raise ValueError("target_bytes must be positive and fan at least 2")
        self.spark, self.path, self.target, self.fan = spark, path.rstrip("/"), target_bytes, fan
        self._jvm = spark._jvm
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``{version, schema, lists: [{path, shards, small}]}``; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "lists": []}
        return json.loads(self._text(f"{self.path}/manifest/{version:020d}"))

    def _text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def shards(self, manifest: dict, small: bool = False) -> list[dict]:
        """``{path, bytes, list}`` of a version; with ``small`` those in lists that hold small shards."""
        names = [x["path"] for x in manifest["lists"] if x["small"] or not small]
        if not names:
            return []
        rows = self.spark.read.json([f"{self.path}/{n}" for n in names], schema="path string, bytes long").select("*", F.col("_metadata.file_name").alias("list")).collect()
        return [{"path": r.path, "bytes": r.bytes, "list": f"lists/{r.list}"} for r in rows]

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _listed(self, shards: list[dict]) -> list[dict]:
        """New lists of ``shards``: small ones and done ones apart."""
        out = []
        for small in (True, False):
            of = [x for x in shards if (x["bytes"] < self.target / 2) == small]
            for k in range(0, len(of), LIST_SHARDS):
                part = of[k : k + LIST_SHARDS]
                name = f"lists/{uuid.uuid4().hex}"
                self._put(f"{self.path}/{name}", "".join(json.dumps({"path": x["path"], "bytes": x["bytes"]}) + "\n" for x in part))
                out.append({"path": name, "shards": len(part), "small": small})
        return out

    def commit(self, base: dict, schema: StructType, added: list[dict], removed: list[dict] = ()) -> dict:
        """Publish ``base`` without ``removed`` and with ``added`` as the next version; RuntimeError if another writer was first.

        Lists that hold removed shards are written anew; so are short lists once there are many.
        """
        gone, touched = {x["path"] for x in removed}, {x["list"] for x in removed}
        short = [x["path"] for x in base["lists"] if x["shards"] < LIST_SHARDS // 16]
        touched |= set(short) if len(short) >= SHORT_LISTS else set()
        rest = [x for x in self.shards({"lists": [x for x in base["lists"] if x["path"] in touched]}) if x["path"] not in gone]
        written = self._listed([*rest, *added])
        new = {"version": base["version"] + 1, "schema": schema.jsonValue(), "lists": [x for x in base["lists"] if x["path"] not in touched] + written}
        folder = f"{self.path}/manifest"
        self._fs.mkdirs(self._path(folder))
        hidden, final = f"{folder}/.{uuid.uuid4().hex}", self._path(f"{folder}/{new['version']:020d}")
        self._put(hidden, json.dumps(new))
        try:
            self._rename(self._path(hidden), final)
        except Py4JJavaError as e:
            self.discard([{"path": x["path"]} for x in written])
            self._fs.delete(self._path(hidden), False)
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            raise RuntimeError(f"version {new['version']} was committed by another writer") from None
        return new

    def _rename(self, source, target) -> None:
        """Rename without overwriting; the file system itself refuses a target that exists."""
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)

    # Shards

    def _written(self, folder: str) -> list[dict]:
        """The shards that a finished write left in ``folder``."""
        where = self._path(folder)
        files = self._fs.listStatus(where) if self._fs.exists(where) else []
        found = [(f.getPath().getName(), f.getLen()) for f in files]
        return [{"path": f"{folder[len(self.path) + 1:]}/{n}", "bytes": b} for n, b in sorted(found) if n.endswith(".parquet")]

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._written(folder)

    def _read(self, shards: list[dict], schema: StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['path']}" for s in shards))

    @staticmethod
    def merged_schema(old: StructType | None, new: StructType) -> StructType:
        """The columns of both, nullable; ValueError where one name has two types or two names differ in case only."""
        fields = {f.name: StructField(f.name, f.dataType, True) for f in old or ()}
        for f in new:
            mine = fields.setdefault(f.name, StructField(f.name, f.dataType, True))
            if mine.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {mine.dataType.simpleString()}, not {f.dataType.simpleString()}")
        if len({n.lower() for n in fields}) < len(fields):
            raise ValueError("column names differ in case only")
        return StructType(list(fields.values()))

    def append(self, arrivals: DataFrame) -> dict:
        base = self.manifest()
        schema = self.merged_schema(StructType.fromJson(base["schema"]) if base["schema"] else None, arrivals.schema)
        return self.commit(base, schema, self._write(arrivals))

    def tier(self, n_bytes: int) -> int:
        """0 for shards of the target size, 1 for those down to a ``fan``-th of it, and so on."""
        return max(0, math.ceil(math.log(self.target / max(1, n_bytes), self.fan) - 1e-9))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """The runs to merge. Shards from half the target on are done."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target / 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [t for k, t in sorted(tiers.items()) if len(t) >= self.fan]

    def _merge(self, run: list[dict], schema: StructType) -> list[dict]:
        """Merge similarly sized shards into files of about the target size."""
        setting = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in setting}
        try:
            for k, v in setting.items():
                self.spark.conf.set(k, v)
            return self._write(self._read(run, schema))
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def compact(self) -> dict:
        """Merge until no tier has ``fan`` shards that pack; each round is one version. Returns the last manifest."""
        base = self.manifest()
        settled: set[str] = set()  # shards of runs that the scan could not pack any further
        for _ in range(64):
            schema = StructType.fromJson(base["schema"]) if base["schema"] else None
            added, removed = [], []
            for run in self.plan([x for x in self.shards(base, small=True) if x["path"] not in settled]):
                merged = self._merge(run, schema)
                if len(merged) < len(run):
                    added, removed = added + merged, removed + run
                else:
                    self.discard(merged)
                    settled |= {x["path"] for x in run}
            if not removed:
                break
            base = self.commit(base, schema, added, removed)
        return base

    def discard(self, shards: list[dict]) -> None:
        for s in shards:
            self._fs.delete(self._path(f"{self.path}/{s['path']}"), False)

    def vacuum(self, keep_versions: int = 1) -> None:
        """Forget all but the last versions and delete the lists and shards that only they named."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep_versions:]]
        lists = {x["path"] for m in kept for x in m["lists"]}
        old = {x["path"]: x for v in versions[:-keep_versions] for x in self.manifest(v)["lists"] if x["path"] not in lists}
        if old:
            still = {s["path"] for m in kept for s in self.shards(m)}
            self.discard(list({s["path"]: s for s in self.shards({"lists": list(old.values())}) if s["path"] not in still}.values()))
        for v in versions[:-keep_versions]:
            self._fs.delete(self._path(f"{self.path}/manifest/{v:020d}"), False)
        self.discard(list(old.values()))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError(f"no version has been committed at {self.path}")
        return self._read(self.shards(m), StructType.fromJson(m["schema"]))


def shard(arrivals: Sequence[DataFrame], path: str, target_bytes: int = TARGET_BYTES, fan: int = FAN) -> ShardStore:
    """Append all arrivals to the store at ``path``, one version each, compact it and drop what the result doesn't need."""
    store = ShardStore(arrivals[0].sparkSession, path, target_bytes, fan)
    for a in arrivals:
        store.append(a)
    store.compact()
    store.vacuum()
    return store


def by_files(spark: SparkSession, sf_dir: str, name: str, most: int = ARRIVALS) -> list[DataFrame]:
    """A table of a folder as at most ``most`` arrivals of whole files each."""
    whole = table(spark, sf_dir, name)
    files = sorted(whole.inputFiles())
    if len(files) < 2:
        return [whole]
    return [spark.read.schema(whole.schema).parquet(*files[k::most]) for k in range(min(most, len(files)))]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the shard that holds it, read back from the committed version; the table's files arrive in turn."""
    store = shard(by_files(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang", "source", "n_chars", (F.input_file_name() != "").alias("in_shard"))


SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars, true AS in_shard FROM documents"
