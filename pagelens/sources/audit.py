"""The audit log as a stored table of JSON lines that is rotated while others append to it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.sources.pages import AUDIT

#: Records kept by a rotation, which happens once there are over twice as many.
KEEP = 5000


class AuditLog:
    """Appended files in ``path`` and, beside it, the rotations: what each kept, and a manifest that says which files it stands for.

    A manifest is written whole under another name and renamed, which fails if
    its number is taken: of two rotations at a time one counts. A reader takes
    the latest manifest's records and the files it does not name, so appends
    that come meanwhile are neither lost nor read twice. Files a manifest stands
    for are deleted by the rotation after it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.side = spark, path.rstrip("/"), f"{path.rstrip('/')}.rotated"
        self.fs = self._at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _text(self, path: str) -> str:
        stream = self.fs.open(self._at(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def appended(self) -> list[str]:
        """Names of the files that appends have completed; a name for each batch since the last rotation."""
        return [n for n in self._names(self.path) if n.startswith("part-")]

    def manifest(self) -> dict:
        """The latest rotation: its number, the files it stands for, records kept and dropped so far."""
        known = [n for n in self._names(self.side) if n.endswith(".manifest")]
        return json.loads(self._text(f"{self.side}/{known[-1]}")) if known else {"number": 0, "folder": None, "files": [], "kept": 0, "dropped": 0}

    def append(self, batch: DataFrame) -> None:
        """Append records; pass it to ``foreachBatch`` for a stream."""
        batch.write.mode("append").json(self.path)

    def _rows(self, manifest: dict, files: list[str]) -> DataFrame:
        gone = set(manifest["files"])
        paths = [f"{self.path}/{n}" for n in files if n not in gone]
        if manifest["folder"]:
            paths.append(manifest["folder"])
        if not paths:
            return self.spark.createDataFrame([], AUDIT)
        return self.spark.read.schema(AUDIT).json(paths).where("seq is not null")

    def read(self) -> DataFrame:
        """All records kept; a malformed line is left out."""
        return self._rows(self.manifest(), self.appended())

    def rotate(self, keep: int = KEEP) -> dict:
        """Keep the newest ``keep`` records by ``seq`` once there are over twice as many.

        Returns the manifest that holds afterwards, with ``rotated``, whether
        this call made it.
        """
        now = self.manifest()
        files = self.appended()
        rows = self._rows(now, files)
        total = rows.count()
        if total <= 2 * keep:
            return {**now, "rotated": False}
        number = now["number"] + 1
        folder = f"{self.side}/kept-{number:09d}-{uuid.uuid4().hex}"
        rows.orderBy(F.desc("seq")).limit(keep).write.json(folder)
        new = {"number": number, "folder": folder, "files": files, "kept": keep, "dropped": now["dropped"] + total - keep}
        draft = self._at(f"{self.side}/{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        final = self._at(f"{self.side}/{number:09d}.manifest")
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            self.fs.delete(self._at(folder), True)
            return {**self.manifest(), "rotated": False}
        for name in set(now["files"]) & set(files):
            self.fs.delete(self._at(f"{self.path}/{name}"), False)
        if now["folder"]:
            self.fs.delete(self._at(now["folder"]), True)
        return {**new, "rotated": True}
