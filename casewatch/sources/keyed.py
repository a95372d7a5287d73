"""Tables in parts whose commits are whole or nothing.

Rows lie in parts, by a hash of their key or by a column such as a day. A commit
writes its files into a folder of its own that nobody reads, then puts one
manifest in place by a rename that fails if another writer was faster: the
manifest names the folders that each part is read from and the last batch of
each writer. So a batch that broke off halfway leaves nothing to read, one that
is run again changes nothing, and of two writers the later one looks at what the
earlier one left before it tries again. Only the parts that a batch touches are
read and written; the folders that two versions no longer name are removed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times a commit is tried anew when other writers are faster.
TRIES = 20
#: Folders of a part from which an append writes it anew, as one.
FOLDERS = 16
#: Shares that a part's rows are dealt into by their keys, so that a large part isn't written by one task; small ones are put together by Spark.
SHARES = 64

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A table under ``path``; ``parts`` hashed parts of ``key``, or a part for each value of ``by``, a column of type string."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], parts: int = 32, by: str | None = None) -> None:
        self.spark, self.path, self.key, self.n, self.by = spark, path.rstrip("/"), key, parts, by

    # ------------------------------------------------------------- files

    def _at(self, *names: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, fs = self._at("manifests")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(place) if f.getPath().getName()[0].isdigit()) if fs.exists(place) else []

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the current one unless given: version, schema, parts (folders of each), writers (last batch of each), touched (its parts)."""
        if version is None and not (known := self.versions()):
            return {"version": 0, "schema": None, "parts": {}, "writers": {}, "touched": {}}
        place, fs = self._at("manifests", f"{known[-1] if version is None else version:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """Make this the current manifest; False if there is one of its version already."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        final, fs = self._at("manifests", f"{manifest['version']:012d}.json")
        staged, _ = self._at("manifests", f".{uuid.uuid4()}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(staged, final, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    # ------------------------------------------------------------- reading

    def part(self) -> Column:
        return F.col(self.by) if self.by else F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("string")

    def folder(self, token: str, part: str) -> str:
        return f"{self.path}/data/{token}/part_={part}"

    def _read(self, manifest: dict, parts: list[str] | None, schema: StructType) -> DataFrame:
        wanted = manifest["parts"] if parts is None else {p: manifest["parts"][p] for p in parts if p in manifest["parts"]}
        folders = [self.folder(token, p) for p, tokens in wanted.items() for token in tokens]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, schema: StructType | None = None) -> DataFrame:
        """All rows of the current version; ``schema`` is needed only while nothing was written."""
        m = self.manifest()
        return self._read(m, None, StructType.fromJson(m["schema"]) if m["schema"] else schema)

    def read_touched(self, writer: str, schema: StructType | None = None) -> DataFrame:
        """Rows of the parts that the last batch of a writer touched."""
        m = self.manifest()
        return self._read(m, m["touched"].get(writer, []), StructType.fromJson(m["schema"]) if m["schema"] else schema)

    def is_done(self, writer: str, batch: int) -> bool:
        return self.manifest()["writers"].get(writer, -1) >= batch

    # ------------------------------------------------------------- writing

    def merge(self, rows: DataFrame, combine: Combine, writer: str, batch: int) -> bool:
        """Replace the parts that ``rows`` touch by ``combine(old rows of these parts, rows)``; False if this batch was merged before.

        ``combine`` must leave each row in its part, that is, keep its key.
        """
        return self._commit(rows, combine, writer, batch, replace=True)

    def append(self, rows: DataFrame, fresh: Combine, writer: str, batch: int) -> bool:
        """Add ``fresh(keys that these parts hold, rows)``; a part of many small folders is written anew. False if this batch was added before."""
        return self._commit(rows, fresh, writer, batch, replace=False)

    def _commit(self, rows: DataFrame, combine: Combine, writer: str, batch: int, replace: bool) -> bool:
        if self.is_done(writer, batch):
            return False
        rows = rows.persist()
        try:
            touched = [r.part_ for r in rows.select(self.part().alias("part_")).distinct().collect()]
            if odd := [p for p in touched if p is None or not re.fullmatch(r"[\w-]+", p)]:
                raise ValueError(f"{self.by} can't name a part: {odd[0]!r}")
            seen: dict | None = None
            for _ in range(TRIES):
                m = self.manifest()
                if m["writers"].get(writer, -1) >= batch:
                    return False
                # What another writer committed meanwhile matters only if it touched a part of this batch.
                if seen is None or any(m["parts"].get(p) != seen["parts"].get(p) for p in touched):
                    seen = m
                    schema, changed = self._write(m, rows, touched, combine, replace)
                parts = {p: t for p, t in (m["parts"] | changed).items() if t}
                now = {"version": m["version"] + 1, "schema": json.loads(schema.json()), "parts": parts, "writers": m["writers"] | {writer: batch}, "touched": m["touched"] | {writer: touched}}
                if self._put(now):
                    self._clean(now)
                    return True
            raise RuntimeError(f"{TRIES} commits of other writers came before that of {writer}")
        finally:
            rows.unpersist()

    def _write(self, m: dict, rows: DataFrame, touched: list[str], combine: Combine, replace: bool) -> tuple[StructType, dict[str, list[str]]]:
        """The schema, and what each touched part is read from once this is committed."""
        schema = StructType.fromJson(m["schema"]) if m["schema"] else None
        old = self._read(m, touched, schema or rows.schema)
        out = combine(old if replace else old.select(*self.key), rows)
        anew = touched if replace else [p for p in touched if len(m["parts"].get(p, [])) >= FOLDERS]
        if anew and not replace:
            out = out.unionByName(self._read(m, anew, schema))
        token = str(uuid.uuid4())
        out.withColumn("part_", self.part()).repartition("part_", F.pmod(F.xxhash64(*self.key), F.lit(SHARES))).write.partitionBy("part_").parquet(f"{self.path}/data/{token}")
        # A part that has no rows left has no folder.
        written = {p for p in touched if self._exists(self.folder(token, p))}
        kept = {p: [] if p in anew else m["parts"].get(p, []) for p in touched}
        return out.schema, {p: kept[p] + [token] * (p in written) for p in touched}

    def _exists(self, folder: str) -> bool:
        place, fs = self._at(folder.removeprefix(f"{self.path}/"))
        return fs.exists(place)

    def _clean(self, now: dict) -> None:
        """Remove what only versions before the last named; a reader of the last one isn't disturbed."""
        gone = [v for v in self.versions() if v < now["version"] - 1]
        if not gone:
            return
        named = lambda m: {self.folder(t, p) for p, tokens in m["parts"].items() for t in tokens}
        before = self.manifest(now["version"] - 1)
        old = set().union(*(named(self.manifest(v)) for v in gone)) - named(now) - named(before)
        for folder in sorted(old):
            place, fs = self._at(folder.removeprefix(f"{self.path}/"))
            fs.delete(place, True)
        for v in gone:
            place, fs = self._at("manifests", f"{v:012d}.json")
            fs.delete(place, False)


def latest(key: list[str], updated: str) -> Combine:
    """Combine by the greatest ``updated``; ties by the rest of the row, so that the order of batches has no bearing."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in (*key, updated)]
        return old.unionByName(new).groupBy(*key).agg(F.max(F.struct(updated, *rest)).alias("x_")).select(*key, "x_.*").select(*new.columns)

    return combine
