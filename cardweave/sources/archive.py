"""ZIP archives as a data source: a partition for a run of members, read one at a time.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("path", folder).load()

gives (label, content) of the members with an allowed suffix, nested archives too: ``archive.zip#asset0``, numbered as
``payload.expand_archives`` numbers them, by sorted names. An archive's table of contents is all that planning reads. A task opens
the archive, seeks its own members and streams each: no archive is a row, and none is in memory. A member, and a nested
archive, may have ``max_member_mb`` when expanded, which is checked while it is read and not by what its header says; archives may be nested
``max_depth`` deep. Beyond these it is an error, as is a damaged archive unless ``skip_damaged`` is set.

Python opens the files itself, so the path is a folder that driver and executors share as files. For other stores there is ``payload.expand_archives``.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cardweave.sources.payload import SUFFIXES

_CHUNK = 1 << 20


class Members(InputPartition):
    """A run of an archive's members, by their places in the order of names."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives are opened as files, which {parts.scheme}:// does not give: use expand_archives")
    return unquote(parts.path) if parts.scheme else path


def _entries(archive: zipfile.ZipFile, suffixes: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(name, whether it is an archive) of the members that count, in order."""
    names = (n for n in sorted(archive.namelist()) if not n.endswith("/") and not n.rsplit("/", 1)[-1].startswith("."))
    return [(n, n.lower().endswith(".zip")) for n in names if n.lower().endswith((".zip", *suffixes))]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = local_path(options["path"])
        self.suffixes = tuple(s.strip().lower() for s in options["suffixes"].split(",")) if options.get("suffixes") else SUFFIXES
        self.per_task = int(options.get("members_per_task", 1000))
        self.most = int(float(options.get("max_member_mb", 256)) * (1 << 20))
        self.deepest = int(options.get("max_depth", 8))
        self.skip_damaged = options.get("skip_damaged", "false").lower() == "true"

    def _archives(self) -> list[str]:
        if os.path.isfile(self.folder):
            return [self.folder]
        if not os.path.isdir(self.folder):
            raise FileNotFoundError(self.folder)
        return sorted(os.path.join(d, f) for d, _, files in os.walk(self.folder) for f in files if f.lower().endswith(".zip") and not f.startswith("."))

    def partitions(self) -> list[Members]:
        out = []
        for path in self._archives():
            try:
                with zipfile.ZipFile(path) as z:
                    n = len(_entries(z, self.suffixes))
            except zipfile.BadZipFile:
                if not self.skip_damaged:
                    raise
                continue
            out += [Members(path, s, min(s + self.per_task, n)) for s in range(0, n, self.per_task)]
        return out or [Members("", 0, 0)]

    def _content(self, archive: zipfile.ZipFile, name: str, label: str) -> bytes:
        parts, size = [], 0
        with archive.open(name) as f:
            while chunk := f.read(_CHUNK):
                size += len(chunk)
                if size > self.most:
                    raise ValueError(f"{label} is larger than {self.most} bytes")
                parts.append(chunk)
        return b"".join(parts)

    def _expand(self, archive: zipfile.ZipFile, label: str, entries: list[tuple[str, bool]], first: int, depth: int) -> Iterator[tuple[str, bytes]]:
        for i, (name, nested) in enumerate(entries, first):
            own = f"{label}#asset{i}"
            if not nested:
                yield own, self._content(archive, name, own)
                continue
            if depth >= self.deepest:
                raise ValueError(f"{own} is nested deeper than {self.deepest}")
            try:
                inner = zipfile.ZipFile(io.BytesIO(self._content(archive, name, own)))
            except zipfile.BadZipFile:
                if not self.skip_damaged:
                    raise
                continue
            with inner:
                yield from self._expand(inner, own, _entries(inner, self.suffixes), 0, depth + 1)

    def read(self, partition: Members) -> Iterator[tuple[str, bytes]]:
        if not partition.path:
            return
        with zipfile.ZipFile(partition.path) as z:
            yield from self._expand(z, partition.path, _entries(z, self.suffixes)[partition.start : partition.end], partition.start, 1)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "label string, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)
