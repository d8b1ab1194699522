"""Chunk tables in versions: changes write beside what is there, then one manifest is put in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that the table adds: which version of a key its rows are, and whether it has none.
ORDER, GONE = "_order", "_gone"


class Snapshots:
    """A table under `path` whose parts, one for each value of `by`, are replaced by versions.

    A version is a manifest, `_versions/<number>.json`: the schema, and for each part the folder below `data` that holds its
    rows. A change writes the parts it touches into a new folder; the others stay where they are. Only when all is
    written does the next manifest appear, by one rename. So readers see one version or the other, and a change that
    fails leaves nothing but a folder that no version names (`vacuum` removes it). One writer at a time: one that finds
    its version taken fails and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, by: str) -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/_versions") if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = version or self.version()
        if not version:
            return {"version": 0, "schema": None, "parts": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version:09d}.json", wholetext=True).first()[0])

    def _more(self) -> dict:
        return {}

    def _publish(self, version: int, schema: StructType, parts: dict[str, str]) -> None:
        text = json.dumps({"version": version, "schema": schema.json(), "parts": parts} | self._more())
        fs, made = self._fs(f"{self.path}/_versions/_{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        to = self._fs(f"{self.path}/_versions/{version:09d}.json")[1]
        if fs.exists(to) or not fs.rename(made, to):
            fs.delete(made, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    def _rows(self, manifest: dict, parts: set[str] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/data/{folder}/{self.by}={b}" for b, folder in sorted(manifest["parts"].items()) if parts is None or unquote(b) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame, parts: dict[str, str], version: int) -> int:
        """Publish a version: the parts of `rows` (which have the column `by`), and `parts` as they are."""
        folder = uuid.uuid4().hex
        rows.write.partitionBy(self.by).option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        made = {n.removeprefix(f"{self.by}=") for n in self._names(f"{self.path}/data/{folder}") if n.startswith(f"{self.by}=")}
        self._publish(version, rows.drop(self.by).schema, parts | dict.fromkeys(made, folder))
        return version

    def parts(self, version: int | None = None, wanted: set[str] | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given, or of some of its parts."""
        d = self._rows(self.manifest(version), wanted)
        if d is None:
            raise ValueError(f"{self.path} holds no version")
        return d

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the latest `keep` versions and the folders that none of those names. Not while a change runs."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in self.manifest(v)["parts"].values()}
        for v in versions[:-keep]:
            fs, p = self._fs(f"{self.path}/_versions/{v:09d}.json")
            fs.delete(p, False)
        for name in self._names(f"{self.path}/data"):
            if name not in used:
                fs, p = self._fs(f"{self.path}/data/{name}")
                fs.delete(p, True)


class ChunkTable(Snapshots):
    """Rows in versions, any number for each key, dealt by the key's hash into `buckets`; a change reads and writes the
    buckets it touches. `buckets` is fixed when the table is made; a bucket is what one task writes. Rows without key are
    those of one key, null.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        super().__init__(spark, path, "bucket")
        self.key, self.buckets = key, buckets
        if self.version():
            self.buckets = self.manifest()["buckets"]

    def _more(self) -> dict:
        return {"buckets": self.buckets}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given."""
        return self.parts(version).where(~F.col(GONE)).drop(ORDER, GONE)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def _put(self, rows: DataFrame, parts: dict[str, str], version: int) -> int:
        return self.put(rows.withColumn("bucket", self._bucket()).repartition("bucket"), parts, version)

    def merge(self, rows: DataFrame | None = None, order: int = 0, gone: DataFrame | None = None) -> int:
        """Put `rows` in place of those of their keys, and take away the keys in `gone`; returns the new version.

        A key keeps the rows of its greatest `order`, and of equal orders those that came last: what is written again after a
        failure changes nothing, and what comes late does not replace what is newer. Keys in `gone` stay noted with their
        order, so that older rows do not bring them back. Columns that one side lacks are null there.
        """
        now = self.manifest()
        added = [rows.withColumns({ORDER: F.lit(order).cast("long"), GONE: F.lit(False)})] if rows is not None else []
        added += [gone.select(self.key).distinct().withColumns({ORDER: F.lit(order).cast("long"), GONE: F.lit(True)})] if gone is not None else []
        if not added:
            return now["version"]
        new = added[0] if len(added) == 1 else added[0].unionByName(added[1], allowMissingColumns=True)
        touched = {str(r[0]) for r in new.select(self._bucket()).distinct().collect()}  # `buckets` numbers at most
        old = self._rows(now, touched)
        new = new.withColumn("_new", F.lit(1))
        both = new if old is None else old.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        age = F.struct(ORDER, "_new")
        kept = both.withColumn("_last", F.max(age).over(Window.partitionBy(self.key))).where(age == F.col("_last")).drop("_new", "_last")
        return self._put(kept, {b: f for b, f in now["parts"].items() if b not in touched}, now["version"] + 1)

    def delete(self, keys: DataFrame, order: int) -> int:
        """Take away the rows of the keys, unless those are of a greater order."""
        return self.merge(order=order, gone=keys)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """A version with all rows changed; `change` keeps the key and the table's own columns."""
        now = self.manifest()
        d = self._rows(now)
        if d is None:
            raise ValueError(f"{self.path} holds no version")
        return self._put(change(d), {}, now["version"] + 1)
