"""Folders of tables whose current content is named by numbered commits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """Numbered commits below `path`. A commit appears by one rename, so readers see it whole or not at all.

    Commits are never changed. `tidy` deletes all but the last `generations` and the folders that those do not name;
    with two, a reader or a retry that still holds the last but one goes on undisturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        path = self._at(folder)
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def read(self, number: int) -> dict:
        stream = self._files.open(self._at(f"commits/{number:020d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict | None]:
        """Number and content of the newest commit; (-1, None) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def put(self, number: int, content: dict) -> None:
        """`content["folders"]` lists the folders below data/ that the commit names."""
        hidden = self._at(f"pending/{uuid.uuid4().hex}")
        out = self._files.create(hidden, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        target = self._at(f"commits/{number:020d}")
        self._files.mkdirs(target.getParent())
        if self._files.exists(target) or not self._files.rename(hidden, target):
            raise FileExistsError(f"commit {number} of {self.path} exists")

    def folder(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def tidy(self, generations: int = 2) -> None:
        numbers = self.numbers()
        kept = {name for n in numbers[-generations:] for name in self.read(n)["folders"]}
        for n in numbers[:-generations]:
            self._files.delete(self._at(f"commits/{n:020d}"), False)
        for name in self._names("data"):
            if name not in kept:
                self._files.delete(self._at(f"data/{name}"), True)
