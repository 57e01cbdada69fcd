"""An index that is kept up: versions of segments in a folder, merged on read.

Documents are added, changed and removed in batches. A batch is a segment: the chunks and postings of its documents, which are
complete as every document is a scope of its own, and the ids that it touches. A version is a small file that lists segments in
order, written under a private name and renamed, so a reader sees a whole version or the one before. On read, a row
of a segment counts unless a later one touches its document; the anti joins are on ids alone. Compaction writes what is left as
one segment. Nothing is rewritten in between, and an older version stays readable until its segments are deleted.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..functions import lexicon as L
from .chunking import chunk_documents
from .index import Index, postings, with_stems


class IndexStore:
    """Versions of an index over documents (doc_id, text) in ``folder``, which all executors share. One writer at a time.

    A document that is given again replaces itself; null ids are not indexed, as they cannot be replaced; repeated ids in a batch
    count as documents that share their postings, as they do in :func:`build_index`.
    """

    def __init__(self, spark: SparkSession, folder: str, target: float = L.TARGET_CHARS, overlap: float = L.OVERLAP_CHARS):
        self.spark, self.folder, self.target, self.overlap = spark, folder.rstrip("/"), target, overlap

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self) -> list[int]:
        system, path = self._path("versions")
        if not system.exists(path):
            return []
        names = [f.getPath().getName() for f in system.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def segments(self, version: int | None = None) -> list[str]:
        """Names of the segments of a version (the last one), oldest first."""
        found = self.versions()
        if not found or version is not None and version not in found:
            return []
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{found[-1] if version is None else version}", wholetext=True).first().value)

    def _publish(self, segments: list[str]) -> int:
        version = (self.versions() or [0])[-1] + 1
        system, private = self._path(f"versions/_{uuid.uuid4().hex}")
        out = system.create(private)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        if not system.rename(private, self._path(f"versions/{version}")[1]):
            raise RuntimeError("another writer has published this version")
        return version

    def _write(self, touched: DataFrame, chunks: DataFrame) -> str:
        name = uuid.uuid4().hex[:16]
        base = f"{self.folder}/segments/{name}"
        touched.distinct().write.parquet(f"{base}/touched")
        with_stems(chunks).write.parquet(f"{base}/chunks")
        postings(self.spark.read.parquet(f"{base}/chunks")).write.parquet(f"{base}/postings")
        return name

    def _table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segments/{segment}/{name}")

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None) -> int:
        """Add or replace ``docs`` (doc_id, text) and remove the ids of ``removed`` (doc_id); the number of the new version."""
        given = docs.where("doc_id IS NOT NULL")
        ids = given.select("doc_id") if removed is None else given.select("doc_id").unionByName(removed.select("doc_id"))
        return self._publish([*self.segments(), self._write(ids, chunk_documents(given, self.target, self.overlap))])

    def open(self, version: int | None = None) -> Index:
        """The index of a version (the last one). Raises where there is none."""
        names = self.segments(version)
        if not names:
            raise ValueError("no such version")
        return Index(self._merged(names, "chunks"), self._merged(names, "postings"))

    def _merged(self, names: list[str], table: str) -> DataFrame:
        parts = []
        for i, name in enumerate(names):
            rows = self._table(name, table)
            later = [self._table(n, "touched") for n in names[i + 1 :]]
            parts.append(rows.join(reduce(DataFrame.unionByName, later).distinct(), "doc_id", "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, parts)

    def compact(self) -> int:
        """Write the last version as one segment; the number of the new version."""
        names = self.segments()
        index, name = self.open(), uuid.uuid4().hex[:16]
        base = f"{self.folder}/segments/{name}"
        index.chunks.select("doc_id").distinct().write.parquet(f"{base}/touched")
        index.chunks.write.parquet(f"{base}/chunks")
        index.postings.write.parquet(f"{base}/postings")
        if self.segments() != names:
            raise RuntimeError("another writer has published a version")
        return self._publish([name])

    def clean(self, keep: int = 1) -> int:
        """Delete versions before the last ``keep``, and segments that no version left lists; how many segments went."""
        found = self.versions()
        for v in found[:-keep]:
            system, path = self._path(f"versions/{v}")
            system.delete(path, True)
        used = {s for v in found[-keep:] for s in self.segments(v)}
        system, path = self._path("segments")
        gone = [f.getPath() for f in system.listStatus(path) if f.getPath().getName() not in used]
        for p in gone:
            system.delete(p, True)
        return len(gone)
