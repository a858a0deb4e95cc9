"""Tables stored in layers: a base, and small layers of later batches over it, merged by key when they are read.

A layer is a folder of Parquet tables. Its table `gone` names the keys that it replaces or deletes in all layers below; a row is visible if no
layer above its own names its key. A batch writes one layer, so it writes what it holds and no more. The pointer of a version lists its layers;
two writers cannot both create the pointer of a version. Compaction writes layers together into one, as another version. Versions that
nobody needs are dropped, with the layers that only they list.

Tables of more than one file are laid out in ranges of a key, and a layer's manifest of it has the first and last key of every file, so a few
keys, or a page of them, are read from the files that can hold them and no others.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.sources.files import Files

#: keys that are looked up by their files (more are joined to the whole table), and that are named to the scan of these
LOOKED_UP, NAMED = 100_000, 1_000
#: replaced keys that are broadcast; beyond it the merge shuffles
BROADCAST_KEYS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class Table:
    """A stored table: its schema, the column that names a row's document (none: rows of all layers count), and the columns whose ranges its files are.

    Without such columns its files are as its tasks write them, and a look-up scans them all.
    """

    schema: str
    key: str | None
    range: tuple[str, ...] = ()
    #: folders of their own for the values of a column, which has few
    parted: str | None = None

    def type_of(self, column: str) -> str:
        return StructType.fromDDL(self.schema)[column].dataType.simpleString()


@dataclass
class LayeredStore:
    """Versions of some tables under one folder of any Hadoop file system."""

    spark: SparkSession
    path: str
    tables: dict[str, Table]
    #: rows of one file, where a table is laid out in ranges
    file_rows: int = 500_000
    #: layers above the base before they are written together, and the share of the base's rows in them from which the base is rewritten
    max_layers: int = 8
    full_share: float = 0.25
    #: versions that readers may still use: the last ones, and any that are younger in seconds
    keep_versions: int = 5
    keep_seconds: float = 600
    files: Files = field(init=False)

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self.files = Files(self.spark, self.path)

    # -- versions

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("_versions") if n.isdigit())

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def pointer(self, version: int | None = None) -> dict:
        """version, layers, streams, counters and the folders of the report and of an index, of the current version unless another is named."""
        v = self.version() if version is None else version
        none = {"version": -1, "layers": [], "streams": {}, "counters": {}, "report": None, "index": None}
        return none if v < 0 else {**none, "version": v, **json.loads(self.files.read(f"_versions/{v}"))}

    def publish(self, base: dict, layers: list[dict], new: str | None, streams: dict[str, int] | None = None, report: str | None = None) -> dict:
        """Create the pointer after `base`; Conflict if another has, and the new folder is dropped then."""
        version = base["version"] + 1
        told = {"layers": layers, "streams": {**base["streams"], **(streams or {})}, "counters": base["counters"], "report": report, "index": base.get("index")}
        if not self.files.create(f"_versions/{version}", json.dumps(told)):
            if new:
                self.files.delete(new)
            raise Conflict(f"version {version} is taken")
        self.vacuum(older_than=self.keep_seconds)
        return {"version": version, **told}

    def vacuum(self, keep: int | None = None, older_than: float = 0) -> list[str]:
        """Drop all but the last `keep` versions (at least one), and the layers that none of those lists; says which folders went.

        A folder without a version is a batch that is being written, or was lost: it goes once it is a day old.
        """
        every = self.versions()
        kept = every[-max(1, self.keep_versions if keep is None else keep) :]
        now = time.time()
        old = [v for v in every if v < kept[0] and now - self.files.modified(f"_versions/{v}") >= older_than] if kept else []
        if not old:
            return []
        listed = lambda vs: {f for v in vs for p in [self.pointer(v)] for f in [*(x["folder"] for x in p["layers"]), p["report"], p["index"]] if f}
        dead = sorted(listed(old) - listed(v for v in every if v not in old))
        lost = [n for n in self.files.names("") if n.startswith("layer-") and n not in listed(every) and now - self.files.modified(n) > 86_400]
        for v in old:  # pointers first: nobody can find a folder that is being dropped
            self.files.delete(f"_versions/{v}")
        for folder in dead + lost:
            self.files.delete(folder)
        return dead + lost

    # -- writing

    def new_folder(self) -> str:
        return f"layer-{uuid.uuid4().hex}"

    def lay_out(self, folder: str, name: str, table: DataFrame, rows: int) -> int:
        """Write one table in ranges of its key, `rows` being about how many it has; returns the number of files asked for."""
        t = self.tables[name]
        n = max(1, math.ceil(rows / self.file_rows))
        if not t.range:
            table.write.parquet(f"{self.path}/{folder}/{name}")
            return 1
        if t.parted:  # a large value is several files
            spread = table.coalesce(1) if n == 1 else table.repartition(n, t.parted, F.pmod(F.xxhash64(*t.range), F.lit(4)))
            spread.write.partitionBy(t.parted).parquet(f"{self.path}/{folder}/{name}")
            return 1
        spread = table.coalesce(1) if n == 1 else table.repartitionByRange(n, *t.range)
        spread.sortWithinPartitions(*t.range).write.parquet(f"{self.path}/{folder}/{name}")
        return n

    def describe(self, folder: str, names: list[str]) -> None:
        """Write the manifests of a layer's tables from their key columns: file, first, last, rows."""
        for name in names:
            t = self.tables[name]
            kept = self.spark.read.schema(t.schema).parquet(f"{self.path}/{folder}/{name}").select(F.col(t.range[0]).alias("k"), F.input_file_name().alias("file"))
            files = kept.groupBy("file").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("rows"))
            files.coalesce(1).write.parquet(f"{self.path}/{folder}/manifest-{name}")

    def add_layer(self, base: dict, tables: dict[str, DataFrame], rows: dict[str, int], streams: dict[str, int] | None = None) -> dict:
        """Write tables (and `gone`, `report`) as a layer over `base` and publish it."""
        folder = self.new_folder()
        layer = self._write(folder, tables, rows)
        return self.publish(base, [*base["layers"], layer], folder, streams, folder if "report" in tables else None)

    def _write(self, folder: str, tables: dict[str, DataFrame], rows: dict[str, int]) -> dict:
        plain = lambda n: tables[n].write.parquet(f"{self.path}/{folder}/{n}") or 1
        work = {n: (lambda n=n: self.lay_out(folder, n, tables[n], rows.get(n, 0))) if n in self.tables else (lambda n=n: plain(n)) for n in tables}
        # a small batch is many short jobs: they run side by side
        with ThreadPoolExecutor(4) as pool:
            files = dict(zip(work, pool.map(lambda f: f(), work.values()), strict=True))
        ranged = [n for n in files if files[n] > 1]
        if ranged:
            self.describe(folder, ranged)
        stored = [n for n in tables if n != "report"]
        return {"folder": folder, "tables": stored, "ranged": ranged, "rows": {n: rows.get(n, 0) for n in stored}}

    # -- reading

    def _gone(self, pointer: dict, keys: list | None = None) -> DataFrame | None:
        """key, at: the highest layer that names a key as gone; none if no layer above the base does."""
        found = [self.spark.read.schema("external_id string").parquet(f"{self.path}/{x['folder']}/gone").withColumn("_at", F.lit(i)) for i, x in enumerate(pointer["layers"]) if i and "gone" in x["tables"]]
        if not found:
            return None
        every = reduce(DataFrame.union, found)
        every = every.filter(F.col("external_id").isin(keys)) if keys is not None else every
        one = every.groupBy(F.col("external_id").alias("_key")).agg(F.max("_at").alias("_at"))
        n = sum(x["rows"].get("gone", 0) for x in pointer["layers"][1:])
        return F.broadcast(one) if keys is not None or n <= BROADCAST_KEYS else one

    def merged(self, name: str, parts: list[DataFrame | None], pointer: dict, keys: list | None = None) -> DataFrame:
        """The visible rows of a table's parts, one for each layer (None: none)."""
        t = self.tables[name]
        found = [p.withColumn("_layer", F.lit(i)) for i, p in enumerate(parts) if p is not None]
        if not found:
            return self.spark.createDataFrame([], t.schema)
        every, gone = reduce(DataFrame.union, found), self._gone(pointer, keys)
        if gone is not None and t.key:
            every = every.join(gone, (F.col(t.key) == F.col("_key")) & (F.col("_layer") < F.col("_at")), "left_anti")
        return every.drop("_layer")

    def _scan(self, layer: dict, name: str, files: list[str] | None = None) -> DataFrame | None:
        if name not in layer["tables"] or files == []:
            return None
        return self.spark.read.schema(self.tables[name].schema).parquet(*(files or [f"{self.path}/{layer['folder']}/{name}"]))

    def read(self, name: str, pointer: dict | None = None) -> DataFrame:
        """The visible rows of a table; a folder that a layer lists and that is not there is an error."""
        p = pointer or self.pointer()
        return self.merged(name, [self._scan(x, name) for x in p["layers"]], p)

    def manifest(self, layer: dict, name: str) -> DataFrame:
        t = self.tables[name]
        k = t.type_of(t.range[0])
        return self.spark.read.schema(f"file string, first {k}, last {k}, rows long").parquet(f"{self.path}/{layer['folder']}/manifest-{name}")

    def files_with(self, layer: dict, name: str, keys: list) -> list[str] | None:
        """The files of a layer's table that can hold some of the keys, one or a few for each at most; None: all, there is no manifest.

        The manifest has a row for each file of the table, which is no more than Spark's own listing of them on the driver.
        """
        if name not in layer["ranged"]:
            return None
        files = sorted((r["first"], r["last"], r["file"]) for r in self.manifest(layer, name).filter("first IS NOT NULL").collect())
        firsts, asked, found = [f for f, _, _ in files], sorted(k for k in keys if k is not None), set()
        for k in asked:
            i = bisect_right(firsts, k) - 1
            while i >= 0 and files[i][1] >= k:  # ranges overlap in a key at most
                found.add(files[i][2])
                i -= 1
        return sorted(found)

    def _named(self, df: DataFrame, column: str, keys: list) -> DataFrame:
        if len(keys) <= NAMED:
            return df.filter(F.col(column).isin(keys))
        asked = self.spark.createDataFrame([(k,) for k in keys], f"_k {df.schema[column].dataType.simpleString()}")
        return df.join(F.broadcast(asked), F.col(column) == F.col("_k"), "left_semi")  # LOOKED_UP keys at most

    def find(self, name: str, keys: list, pointer: dict | None = None, by: str | None = None) -> DataFrame:
        """The visible rows of a table with one of the keys, read from the files that can hold them."""
        p, ranged = pointer or self.pointer(), next(iter(self.tables[name].range), None)
        column = by or ranged
        parts = [self._scan(x, name, self.files_with(x, name, keys) if column == ranged else None) for x in p["layers"]]
        named = [None if d is None else self._named(d, column, keys) for d in parts]
        return self.merged(name, named, p, keys if column == self.tables[name].key and len(keys) <= NAMED else None)

    def find_all(self, name: str, ids: DataFrame, pointer: dict | None = None) -> DataFrame:
        """The visible rows of a table whose key is in ids(external_id), however many those are."""
        few = [r[0] for r in ids.select("external_id").distinct().limit(LOOKED_UP + 1).collect()]
        if len(few) <= LOOKED_UP:
            return self.find(name, few, pointer, self.tables[name].key)
        return self.read(name, pointer).join(ids.select(F.col("external_id").alias("_id")).distinct(), F.col(self.tables[name].key) == F.col("_id"), "left_semi")

    def after(self, name: str, cursor: str | None, limit: int, pointer: dict | None = None) -> DataFrame:
        """Visible rows of a table with keys after the cursor, among them the first `limit`; of each layer the files that can hold those."""
        p, t = pointer or self.pointer(), self.tables[name]
        hidden = sum(x["rows"].get("gone", 0) for x in p["layers"][1:])

        def files(layer: dict) -> list[str] | None:
            if name not in layer["ranged"]:
                return None
            rest = self.manifest(layer, name)
            rest = rest if cursor is None else rest.filter(F.col("last") > cursor)
            out, rows = [], 0
            # a file has rows after the cursor, but only whole files after the first count towards the page
            for r in rest.orderBy("first", "last").toLocalIterator():
                out.append(r["file"])
                rows += r["rows"] if cursor is None or r["first"] > cursor else 0
                if rows >= limit + hidden:
                    break
            return out

        parts = [self._scan(x, name, files(x)) for x in p["layers"]]
        return self.merged(name, [d if d is None or cursor is None else d.filter(F.col(t.key) > cursor) for d in parts], p)

    # -- compaction

    def wants(self, pointer: dict) -> str | None:
        """"all" or "upper" if the layers should be written together, by their number and rows."""
        layers = pointer["layers"]
        if len(layers) <= self.max_layers:
            return None
        base, *upper = layers
        over = sum(sum(x["rows"].values()) for x in upper)
        return "all" if over >= self.full_share * max(1, sum(base["rows"].values())) else "upper"

    def compact(self, which: str = "all") -> dict:
        """Write all layers together into a new base, or the layers above the base into one; the rows stay the same.

        An upper layer of the merged kind keeps the names of all keys that are gone below it.
        """
        base = self.pointer()
        first = 0 if which == "all" else 1
        under, over = base["layers"][:first], base["layers"][first:]
        if not over or first and len(over) < 2:
            return base
        view = {**base, "layers": [{**x, "tables": [n for n in x["tables"] if i or n != "gone"]} for i, x in enumerate(over)]}
        names = [n for n in self.tables if any(n in x["tables"] for x in over)]
        rows = {n: sum(x["rows"].get(n, 0) for x in over) for n in names}
        tables = {n: self.read(n, view) for n in names}
        if first:
            gone = [self.spark.read.schema("external_id string").parquet(f"{self.path}/{x['folder']}/gone") for x in over if "gone" in x["tables"]]
        if first and gone:
            tables["gone"] = reduce(DataFrame.union, gone).distinct().coalesce(max(1, math.ceil(sum(x["rows"].get("gone", 0) for x in over) / self.file_rows)))
            rows["gone"] = sum(x["rows"].get("gone", 0) for x in over)
        if not first and base["counters"]:
            rows["docs"] = base["counters"].get("docs", rows.get("docs", 0))
            rows["segments"] = base["counters"].get("segments", rows.get("segments", 0))
        folder = self.new_folder()
        base = self.prepare(base, which, tables, rows)
        layer = self._write(folder, tables, rows)
        return self.publish(base, [*under, layer], folder, report=base["report"])

    def prepare(self, base: dict, which: str, tables: dict[str, DataFrame], rows: dict[str, int]) -> dict:  # noqa: ARG002
        """Add to the tables that a compaction writes; returns the pointer to go on from."""
        return base
