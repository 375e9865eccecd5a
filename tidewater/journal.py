"""The catalog's versions as JSON files of a folder on any file system that Spark reaches.

A version is written under a name of its own and renamed to its number, which fails if that number is
taken, so of two committers one sees that it came second.  The rename is atomic on HDFS and on local
disks of one writer; on stores that copy to rename, one process at a time should write.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import SparkSession

from tidewater.plans.tokens import Token

#: Versions that are kept, the newest.
KEPT = 10


class Journal:
    """Numbered files of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.names = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def versions(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def newest(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int) -> str:
        stream = self.fs.open(self._path(f"{version}.json"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, version: int, text: str) -> bool:
        """Whether this is now the version's content; false if it was written before."""
        self.fs.mkdirs(self.folder)
        draft = self._path(f"{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: don't overwrite
        try:
            self.names.rename(draft, self._path(f"{version}.json"), options)
        except Exception as e:  # noqa: BLE001  py4j wraps what Java raises
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        for old in self.versions()[:-KEPT]:
            self.fs.delete(self._path(f"{old}.json"), False)
        return True

    def remove(self, kept: set[str]) -> int:
        """Delete the segments, folders of 32 hexadecimal digits inside a table's folder, that aren't kept."""
        names, gone = {k.rsplit("/", 1)[-1] for k in kept}, 0
        for table in self.fs.listStatus(self.folder) if self.fs.exists(self.folder) else []:
            for segment in self.fs.listStatus(table.getPath()) if table.isDirectory() else []:
                name = segment.getPath().getName()
                if len(name) == 32 and name not in names:
                    self.fs.delete(segment.getPath(), True)
                    gone += 1
        return gone


def dumps(state) -> str:
    """A state without its temporary tables."""
    parts = {p: {k: _plain(v) for k, v in getattr(state, p).items() if not getattr(v, "temporary", False)} for p in ("tables", "views", "types", "indexes", "triggers")}
    return json.dumps({**parts, "schemas": sorted(state.schemas)})


def _plain(value):
    if dataclasses.is_dataclass(value):
        return {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value) if f.name != "external"}
    return [_plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def loads(text: str):
    from tidewater import catalog as C

    raw = json.loads(text)

    def tokens(value):
        return None if value is None else tuple(Token(*t) for t in value)

    def table(x):
        columns = tuple(C.Column(**{**c, "default": tokens(c["default"])}) for c in x["columns"])
        constraints = tuple(C.Constraint(**{**c, "columns": tuple(c["columns"]), "check": tokens(c["check"]), "parent_columns": tuple(c["parent_columns"])}) for c in x["constraints"])
        return C.Table(**{**x, "columns": columns, "constraints": constraints, "segments": tuple(x["segments"])})

    return C.State(
        {k: table(x) for k, x in raw["tables"].items()}, {k: tokens(x) for k, x in raw["views"].items()}, frozenset(raw["schemas"]), raw["types"],
        {k: (x[0], tuple(x[1]), x[2]) for k, x in raw["indexes"].items()},
        {k: C.Trigger(**{**x, "columns": tuple(x["columns"]), "condition": tokens(x["condition"]), "body": tokens(x["body"])}) for k, x in raw["triggers"].items()},
    )
