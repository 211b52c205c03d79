"""A verdict table on disk that isn't rewritten or reread whole.

Entries lie in ranges of their text hash. The folder has

* ``data/<token>/bucket=<b>``: a segment, the entries that one upsert brought for a range, or a whole merged range;
* ``filter/<token>/bucket=<b>``: a range's Bloom filter, as bitmaps of 4 KB made by ``bitmap_construct_agg``;
* ``manifest/<version>.json``: for each range its segments and its filter. A version is written aside and put in its
  place by a rename at the end, so readers see the old or the new table, and a failed upsert leaves no trace in it. A
  version that is there already means that another writer was quicker: an error.

An upsert writes its own entries as new segments, and merges only ranges in which segments have become many or
large against the first. A lookup asks the filters first: texts that they don't know are misses without reading an
entry; of the rest only the ranges are read in which there are some. ``vacuum`` removes what old versions left.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.cache import KEY
from plumbline.sources.shared import keep

#: Bits of one bitmap of ``bitmap_construct_agg``.
BLOCK = 32_768
PROBES = 4


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class VerdictStore:
    """Upsert, lookup and size of the verdict table in folder ``root``.

    ``buckets`` ranges are set when the table is made: one for about a million entries. A range is merged when it
    has more than ``segments`` segments, or when later segments together exceed ``share`` of the first.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, segments: int = 8, share: float = 0.5, bits: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        self.segments, self.share, self.bits = segments, share, bits
        found = self._manifest()
        self.buckets = found["n_buckets"] if found else buckets

    # --- manifest

    def versions(self) -> list[int]:
        p, fs = _fs(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if not found:
            return None
        version = found[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{version}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        temp, fs = _fs(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = _fs(self.spark, f"{self.root}/manifest/{manifest['version']}.json")
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise RuntimeError(f"version {manifest['version']} of {self.root} was written by another job")

    # --- places

    def bucket(self, text_hash: Column) -> Column:
        """The range of a hash: its first 16 bits, cut in equal parts."""
        head = F.conv(F.substring(text_hash, 1, 4), 16, 10).cast("int")
        return F.floor(head * self.buckets / 65_536).cast("int")

    @staticmethod
    def _bits(blocks: Column) -> tuple[Column, Column]:
        """(block, places in it) of an entry's key."""
        block = F.pmod(F.xxhash64(F.lit(0), *KEY), blocks)
        places = [F.pmod(F.xxhash64(F.lit(i + 1), *KEY), F.lit(BLOCK)) for i in range(PROBES)]
        return block, F.array(*places)

    def _filters(self, entries: DataFrame, blocks: dict[int, int], token: str, old: dict[int, dict]) -> None:
        """Write the filters of the ranges in ``blocks``: of ``entries``, and of what ``old`` filters hold."""
        of = F.broadcast(self.spark.createDataFrame(list(blocks.items()), "bucket int, blocks long"))
        block, places = self._bits(F.col("blocks"))
        new = entries.join(of, "bucket").select("bucket", block.alias("block"), F.explode(places).alias("place"))
        maps = new.groupBy("bucket", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
        if old:
            paths = [f"{self.root}/filter/{e['filter']}/bucket={b}" for b, e in old.items()]
            before = self.spark.read.schema("block long, bits binary, b int").parquet(*paths).select(F.col("b").alias("bucket"), "block", "bits")
            maps = maps.unionByName(before).groupBy("bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        maps.withColumn("b", F.col("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/filter/{token}")

    # --- reading

    def _read(self, entries: dict[int, list]) -> DataFrame:
        """Live entries of some ranges: of equal keys the one created last, of those the one written last."""
        schema = StructType.fromJson(json.loads(self._schema))

        def segments(of: dict[int, list]) -> DataFrame:
            paths = [f"{self.root}/data/{s['token']}/bucket={b}" for b, ss in of.items() for s in ss]
            return self.spark.read.schema(schema).parquet(*paths)

        one = {b: ss for b, ss in entries.items() if len(ss) == 1}
        many = {b: ss for b, ss in entries.items() if len(ss) > 1}
        parts = [segments(one)] if one else []
        if many:
            rest = [c for c in schema.names if c not in KEY]
            last = F.max_by(F.struct(*rest), F.struct("created", "__seq"))
            parts.append(segments(many).groupBy(*KEY).agg(last.alias("e")).select(*[c if c in KEY else f"e.{c}" for c in schema.names]))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All live entries (of a version that is still there), or None for a table that isn't there yet."""
        m = self._manifest(version)
        if m is None:
            return None
        self._schema = m["schema"]
        return self._read({int(b): e["segments"] for b, e in m["ranges"].items()}).drop("__seq")

    def candidates(self, hashes: DataFrame, backend: str, rubric_version: str) -> DataFrame | None:
        """The live entries that may belong to ``hashes`` (text_hash), or None for a table that isn't there yet.

        Where the filters know none of them, no entry is read.
        """
        m = self._manifest()
        if m is None:
            return None
        self._schema = m["schema"]
        ranges = {int(b): e for b, e in m["ranges"].items()}
        of = F.broadcast(self.spark.createDataFrame([(b, e["blocks"]) for b, e in ranges.items()], "bucket int, blocks long"))
        asked = hashes.select(F.lit(backend).alias("backend"), F.lit(rubric_version).alias("rubric_version"), "text_hash").distinct()
        block, places = self._bits(F.col("blocks"))
        asked = asked.withColumn("bucket", self.bucket(F.col("text_hash"))).join(of, "bucket").withColumns({"block": block, "places": places})
        paths = [f"{self.root}/filter/{e['filter']}/bucket={b}" for b, e in ranges.items()]
        maps = self.spark.read.schema("block long, bits binary, b int").parquet(*paths).withColumnRenamed("b", "bucket")

        hit = F.lit(True)
        for i in range(PROBES):
            place = F.col("places")[i]
            byte = F.conv(F.hex(F.col("bits").substr((F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.floor(byte / F.pow(F.lit(2.0), place % 8)) % 2 == 1)
        maybe = keep(asked.join(maps, ["bucket", "block"]).where(hit).select("bucket", "text_hash"), "maybe")
        wanted = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        own = self._read({b: ranges[b]["segments"] for b in wanted}).drop("__seq")
        return own.where((F.col("backend") == backend) & (F.col("rubric_version") == rubric_version)).join(maybe.select("text_hash"), "text_hash", "left_semi")

    # --- writing

    def note(self) -> int | None:
        """The note of the last upsert."""
        m = self._manifest()
        return m["note"] if m else None

    def upsert(self, new: DataFrame, note: int | None = None) -> dict:
        """Insert or replace by key: of equal keys the entry created last stays, and the new one of equally late.

        Gives the new version and how many entries were written, ranges touched and ranges merged.
        """
        m = self._manifest() or {"version": 0, "n_buckets": self.buckets, "ranges": {}, "next": 0}
        seq, token = m["next"], uuid.uuid4().hex
        rest = [c for c in new.columns if c not in KEY]
        once = new.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "created").alias("e")).select(*KEY, *[f"e.{c}" for c in rest])
        schema = StructType(once.withColumn("__seq", F.lit(seq).cast("long")).schema.fields)
        if "schema" in m and [f.name for f in StructType.fromJson(json.loads(m["schema"]))] != schema.names:
            raise ValueError("the entries have other columns than the table")
        self._schema = m.setdefault("schema", schema.json())
        data = f"{self.root}/data/{token}"
        placed = once.withColumns({"__seq": F.lit(seq).cast("long"), "bucket": self.bucket(F.col("text_hash"))})
        placed.repartition("bucket").sortWithinPartitions("bucket", "text_hash").write.partitionBy("bucket").parquet(data)
        written = self.spark.read.schema(schema).parquet(data)
        brought = {r["bucket"]: r["n"] for r in written.withColumn("bucket", self.bucket(F.col("text_hash"))).groupBy("bucket").agg(F.count("*").alias("n")).collect()}

        ranges = {int(b): e for b, e in m["ranges"].items()}
        merge, grow = [], {}
        for b, n in brought.items():
            e = ranges.setdefault(b, {"segments": [], "filter": None, "blocks": 0})
            e["segments"].append({"token": token, "rows": n})
            later = sum(s["rows"] for s in e["segments"][1:])
            if len(e["segments"]) > self.segments or later > self.share * e["segments"][0]["rows"]:
                merge.append(b)
            else:
                grow[b] = e
        n_written = sum(brought.values())
        if merge:
            merged = uuid.uuid4().hex
            live = self._read({b: ranges[b]["segments"] for b in merge}).withColumn("bucket", self.bucket(F.col("text_hash")))
            live.repartition("bucket").sortWithinPartitions("bucket", "text_hash").write.partitionBy("bucket").parquet(f"{self.root}/data/{merged}")
            live = self.spark.read.schema(schema).parquet(f"{self.root}/data/{merged}").withColumn("bucket", self.bucket(F.col("text_hash")))
            for r in live.groupBy("bucket").agg(F.count("*").alias("n")).collect():
                n_written += r["n"]
                ranges[r["bucket"]] |= {"segments": [{"token": merged, "rows": r["n"]}], "filter": merged, "blocks": self._blocks(r["n"])}
            self._filters(live, {b: ranges[b]["blocks"] for b in merge}, merged, {})
        if grow:
            first = {b: e for b, e in grow.items() if len(e["segments"]) == 1}
            for b, e in first.items():
                e["blocks"] = self._blocks(brought[b])
            own = written.withColumn("bucket", self.bucket(F.col("text_hash")))
            self._filters(own, {b: e["blocks"] for b, e in grow.items()}, token, {b: dict(e) for b, e in grow.items() if b not in first})
            for e in grow.values():
                e["filter"] = token
        m |= {"version": m["version"] + 1, "next": seq + 1, "ranges": ranges, "note": note}
        self._publish(m)
        return {"version": m["version"], "written": n_written, "touched": len(brought), "merged": len(merge)}

    def _blocks(self, n: int) -> int:
        """Bitmaps for ``n`` entries and those that come before the next merge."""
        return max(1, -(-int(n * (1 + self.share)) * self.bits // BLOCK))

    def size(self) -> DataFrame:
        """A7. Entries by scorer and version."""
        entries = self.read()
        return entries.groupBy("backend", "rubric_version").agg(F.count("*").alias("entries"))

    def vacuum(self, versions: int = 1) -> int:
        """Remove all but the last versions and the folders that only removed ones use; gives how many went."""
        kept = {v: self._manifest(v) for v in self.versions()[-versions:]}
        used = {"data": set(), "filter": set()}
        for m in kept.values():
            for e in m["ranges"].values():
                used["data"] |= {s["token"] for s in e["segments"]}
                used["filter"].add(e["filter"])
        gone = 0
        for v in self.versions():
            if v not in kept:
                p, fs = _fs(self.spark, f"{self.root}/manifest/{v}.json")
                fs.delete(p, False)
        for kind, tokens in used.items():
            p, fs = _fs(self.spark, f"{self.root}/{kind}")
            for x in fs.listStatus(p) if fs.exists(p) else []:
                if x.getPath().getName() not in tokens:
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone
