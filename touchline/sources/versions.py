"""Sets of tables promoted together: one manifest names the version that counts.

Tables of a version are written beside the current ones and checked where they lie. Only then the
manifest, a small file, is written under another name and renamed over the old one: a reader sees the
old set or the new one, never a mixture. A failure before that removes what was written, the last table
first; after it nothing has to be undone. Each table that is written and checked is noted in a ledger,
so that a promotion that was cut off goes on after the tables that are done.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Check = Callable[[DataFrame], Iterable[str]]


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """All of a small text file or nothing: written beside it under another name, then renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), options)


class Versions:
    """Versions of named tables under a folder of any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, root: str, after: Callable[[str], None] | None = None):
        self.spark, self.root, self.after = spark, root.rstrip("/"), after or (lambda step: None)
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # Files

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.conf)

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _write(self, name: str, content: str) -> None:
        replace_file(self.spark, f"{self.root}/{name}", content)

    def _read(self, name: str) -> dict | None:
        if not self._exists(name):
            return None
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/{name}").collect())  # one small file
        return json.loads(text)

    # Versions

    def current(self) -> str | None:
        """The version that counts."""
        found = self._read("manifest.json")
        return found["version"] if found else None

    def read(self, table: str) -> DataFrame:
        """A table of the current version; a read that has begun keeps its version."""
        found = self._read("manifest.json")
        if not found or table not in found["tables"]:
            raise KeyError(f"no current version has a table {table}")
        return self.spark.read.parquet(f"{self.root}/{found['tables'][table]}")

    def done(self, version: str) -> list[str]:
        """The tables of a version that are written and checked."""
        return list((self._read(f"{version}/ledger.json") or {"done": []})["done"])

    def promote(self, version: str, tables: dict[str, DataFrame], checks: dict[str, Check] | None = None, expected: dict[str, int] | None = None, keep: bool = False) -> str:
        """Write and check the tables, then let the version count; returns the version before it.

        ``checks`` give the faults of a table as read back; ``expected`` its rows. With ``keep`` the tables
        that are done stay when a later one fails, and the next promotion of this version goes on from them;
        else the version's tables are removed. A version that counts already is not promoted again.
        """
        before = self.current()
        if before == version:
            raise FileExistsError(f"version {version} counts already")
        written: list[str] = []
        try:
            ready = self.done(version)
            for name, df in tables.items():
                if name in ready:
                    continue
                written.append(name)
                df.write.mode("overwrite").parquet(f"{self.root}/{version}/{name}")
                self.after(f"written {name}")
                found = self.spark.read.parquet(f"{self.root}/{version}/{name}")
                faults = list(checks[name](found)) if checks and name in checks else []
                if expected and name in expected and (n := found.count()) != expected[name]:
                    faults.append(f"{n} rows, {expected[name]} expected")
                if faults:
                    raise ValueError(f"{name}: {'; '.join(faults)}")
                ready.append(name)
                self._write(f"{version}/ledger.json", json.dumps({"done": ready}))
                self.after(f"checked {name}")
            if missing := set(expected or ()) - set(tables):
                raise ValueError(f"tables are missing: {', '.join(sorted(missing))}")
        except Exception:
            fs = self._fs()
            if keep:
                for name in reversed([w for w in written if w not in self.done(version)]):
                    fs.delete(self._path(f"{version}/{name}"), True)
            else:
                for name in reversed(written):
                    fs.delete(self._path(f"{version}/{name}"), True)
                fs.delete(self._path(version), True)
            raise
        self._write("manifest.json", json.dumps({"version": version, "before": before, "tables": {n: f"{version}/{n}" for n in tables}}, indent=1))
        self.after("renamed")
        return before

    def roll_back(self) -> str:
        """Let the version before the current one count again; its tables are still there."""
        found = self._read("manifest.json")
        if not found or not found["before"]:
            raise KeyError("there is no version before the current one")
        earlier = found["before"]
        self._write("manifest.json", json.dumps({"version": earlier, "before": None, "tables": {n: f"{earlier}/{n}" for n in self.done(earlier)}}, indent=1))
        return earlier
