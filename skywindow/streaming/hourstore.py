"""Spots by UTC hour as a log-structured table: data files are only ever added, and a manifest says which of them count.

``<path>/data/seg=<id>/hour=<hour>/`` holds what one batch or compaction has written; ``<path>/_manifest/<version>.json`` names
the hours of the segments that make up a version. A version appears by one rename that never replaces a file, so a writer
that dies leaves files that no manifest names, and readers go on with the version they have.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hygiene import REASONS, judged
from ..operators.dedup import dedup_spots
from ..schema import SPOT, as_spots

#: Hours that are in so many segments are compacted.
COMPACT_AT = 8
#: Tries of a commit when other writers get there first.
TRIES = 50


class HourlyStore:
    """``upsert`` adds a batch, ``read`` gives the best spots of a version, ``compact`` and ``vacuum`` keep it small.

    Spots that are in several segments are deduplicated when they are read; hours that are in one aren't touched. The same
    batch of the same writer twice is applied once.
    """

    def __init__(self, spark: SparkSession, path: str, compact_at: int = COMPACT_AT):
        self.spark, self.path, self.compact_at = spark, path.rstrip("/"), compact_at
        jvm = spark._jvm
        self._jvm, self._conf = jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    # --- manifests

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, else of the last one: ``version``, ``segments`` (the hours of each that count), ``written`` (how many
        hours each has) and ``applied`` (the last batch by writer)."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "segments": {}, "written": {}, "applied": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"version {version} is not there")
        stream = self._fs.open(self._at("_manifest", f"{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change: Callable[[dict], dict]) -> dict:
        """Makes the next version out of the last one; if another writer makes it first, out of that writer's."""
        for _ in range(TRIES):
            now = self.manifest()
            new = change(now) | {"version": now["version"] + 1}
            tmp, target = self._at("_manifest", f".{uuid.uuid4().hex}"), self._at("_manifest", f"{new['version']:020d}.json")
            self._fs.mkdirs(self._at("_manifest"))
            out = self._fs.create(tmp, True)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(target), plain)
                return new
            except Py4JJavaError as e:
                self._fs.delete(tmp, False)
                if "FileAlreadyExistsException" not in e.java_exception.toString():
                    raise
        raise RuntimeError(f"no commit after {TRIES} tries")

    # --- writing

    def _write(self, spots: DataFrame) -> tuple[str, list[str]]:
        segment = uuid.uuid4().hex
        by_hour = spots.withColumn("hour", F.date_format("ts", "yyyy-MM-dd-HH")).hint("rebalance", F.col("hour"))
        by_hour.write.partitionBy("hour").parquet(f"{self.path}/data/seg={segment}")
        return segment, sorted(n.removeprefix("hour=") for n in self._names("data", f"seg={segment}") if n.startswith("hour="))

    def upsert(self, batch: DataFrame, batch_id: int = 0, writer: str = "") -> dict[str, int]:
        """Adds the spots of a parsed batch that qualify; how many rows had each reason, counted in the same pass.

        A batch that this writer has applied is left alone and gives no counts.
        """
        if self.manifest()["applied"].get(writer, -1) >= batch_id:
            return {}
        batch = batch if "parse_error" in batch.columns else batch.withColumn("parse_error", F.lit(None).cast("string"))
        rows = judged(as_spots(batch, "parse_error")).withColumn("reason", F.coalesce("parse_error", "reject_reason", F.lit("qualifying")))
        seen = Observation()
        rows = rows.observe(seen, *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("qualifying", "unparsed", *REASONS)])
        best = dedup_spots(as_spots(rows.where("reason = 'qualifying'")))
        segment, hours = self._write(best)

        def add(now: dict) -> dict:
            if now["applied"].get(writer, -1) >= batch_id:
                return now
            more = {"segments": now["segments"] | {segment: hours}, "written": now["written"] | {segment: len(hours)}} if hours else {}
            return now | more | {"applied": now["applied"] | {writer: batch_id}}

        new = self._commit(add)
        if max((len(s) for s in _by_hour(new).values()), default=0) >= self.compact_at:
            self.compact()
        return {k: v for k, v in seen.get.items() if v}

    def compact(self, at_least: int | None = None) -> int:
        """Hours that are in ``at_least`` segments or more get one of their own; how many hours that were."""
        now = self.manifest()
        wanted = {h: s for h, s in _by_hour(now).items() if len(s) >= (at_least or self.compact_at)}
        if not wanted:
            return 0
        segment, hours = self._write(self._best(now, set(wanted)))

        def swap(then: dict) -> dict:
            live = _by_hour(then)
            done = [h for h in wanted if set(wanted[h]) <= set(live.get(h, ()))]  # else another compaction was first
            left = {s: [h for h in hs if not (h in done and s in wanted[h])] for s, hs in then["segments"].items()}
            left |= {segment: [h for h in hours if h in done]}
            left = {s: hs for s, hs in left.items() if hs}
            return then | {"segments": left, "written": {s: n for s, n in (then["written"] | {segment: len(hours)}).items() if s in left}}

        self._commit(swap)
        return len(wanted)

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400) -> int:
        """Deletes all versions but the last ``keep``, and segments of none of those. Younger segments may be of a writer at work."""
        known = self.versions()
        live = {s for v in known[-keep:] for s in self.manifest(v)["segments"]}
        for v in known[:-keep]:
            self._fs.delete(self._at("_manifest", f"{v:020d}.json"), False)
        gone = 0
        for name in self._names("data"):
            at = self._at("data", name)
            if name.removeprefix("seg=") not in live and self._fs.getFileStatus(at).getModificationTime() / 1000 < time.time() - older_than_s:
                gone += self._fs.delete(at, True)
        return gone

    # --- reading

    def _best(self, manifest: dict, hours: set[str] | None) -> DataFrame:
        """The best spots of the asked hours, out of one scan of the folders that count."""
        by_hour = {h: s for h, s in _by_hour(manifest).items() if hours is None or h in hours}
        if not by_hour:
            return self.spark.createDataFrame([], SPOT)
        asked = {}
        for h, segments in by_hour.items():
            for s in segments:
                asked.setdefault(s, []).append(h)
        paths = []
        for s, hs in asked.items():  # the whole folder where all that was written there counts
            paths += [f"{self.path}/data/seg={s}"] if len(hs) == manifest["written"][s] else [f"{self.path}/data/seg={s}/hour={h}" for h in hs]
        places = [T.StructField(n, T.StringType()) for n in ("seg", "hour")]
        rows = self.spark.read.schema(T.StructType(SPOT.fields + places)).option("basePath", f"{self.path}/data").parquet(*paths)
        several = sorted(h for h, s in by_hour.items() if len(s) > 1)
        if not several:
            return as_spots(rows)
        mixed = F.col("hour").isin(several)
        return as_spots(rows.where(~mixed)).unionByName(dedup_spots(as_spots(rows.where(mixed))))

    def read(self, version: int | None = None, hours: list[str] | None = None) -> DataFrame:
        """The spots of a version (by default the last one), of the given hours only or of all."""
        return self._best(self.manifest(version), None if hours is None else set(hours))


def _by_hour(manifest: dict) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for segment, hours in manifest["segments"].items():
        for h in hours:
            out.setdefault(h, []).append(segment)
    return out
