"""``df.write.format("inkspark_zip" | "inkspark_docx" | "inkspark_pdf")``: files written by tasks, visible after the commit.

* zip: (name, content) rows; every task writes ``part-<task>.zip``.
* docx: (file, text) rows with an optional ``style``; consecutive rows of a file are its paragraphs.
* pdf: (file, text) rows with an optional ``size``; consecutive rows of a file are its lines, on as many pages as they take.

Rows of one file must stand together in one task and in order: repartition by ``file`` and sort within partitions first; a file
that comes again later in a task, or from another task, is an error.  Tasks write under ``_unfinished/`` of the target
folder (mounted on all executors) under names of their own attempt; the driver's commit moves what the successful tasks have written and
deletes the rest, so repeated and lost attempts leave nothing behind.  Modes: append adds files, overwrite replaces all.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from ..sources.package import FormatError
from . import packages, pdf

NEEDED = {"zip": ("name", "content"), "docx": ("file", "text"), "pdf": ("file", "text")}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # unfinished path, final name


class FileWriter(DataSourceWriter):
    """Writes of one of the three kinds."""

    def __init__(self, kind: str, options: dict[str, str], columns: list[str], overwrite: bool):
        self.kind, self.overwrite = kind, overwrite
        self.path = options.get("path", "").removeprefix("file://").removeprefix("file:")
        if not self.path:
            raise FormatError("a path is needed")
        if missing := [c for c in NEEDED[kind] if c not in columns]:
            raise FormatError(f"{kind} needs the columns {', '.join(missing)}")
        self.style = {"docx": "style", "pdf": "size"}.get(kind, "")
        self.style = self.style if self.style in columns else ""
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        folder = os.path.join(self.path, "_unfinished", self.job)
        os.makedirs(folder, exist_ok=True)
        out = Written()

        def put(name: str, data: bytes) -> None:
            if not name or "/" in name or "\\" in name or name.startswith((".", "_")):
                raise FormatError(f"not a file name: {name!r}")
            at = os.path.join(folder, uuid.uuid4().hex)
            with open(at, "wb") as f:
                f.write(data)
            out.files.append((at, name))

        if self.kind == "zip":
            entries = [(r["name"], bytes(r["content"] or b"")) for r in iterator]
            if entries:
                put(f"part-{TaskContext.get().partitionId():05d}.zip", packages.zip_bytes(entries))
            return out
        done: set[str] = set()
        name, rows = None, []
        for row in iterator:
            if row["file"] != name:
                if name is not None:
                    put(name, self._document(rows))
                    done.add(name)
                name, rows = row["file"], []
                if name is None or name in done:
                    raise FormatError(f"rows of {name!r} do not stand together")
            rows.append((row["text"] or "", row[self.style] if self.style else None))
        if name is not None:
            put(name, self._document(rows))
        return out

    def _document(self, rows: list[tuple]) -> bytes:
        if self.kind == "pdf":
            return pdf.flow([(text, float(size or 11.0)) for text, size in rows])
        builder = packages.DocxBuilder()
        for text, style in rows:
            builder.paragraph(text, *([style] if style else []))
        return builder.to_bytes()

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise FormatError(f"rows of {next(n for n in names if names.count(n) > 1)!r} come from several tasks")
        if self.overwrite and os.path.isdir(self.path):
            for old in os.listdir(self.path):
                if old != "_unfinished" and os.path.isfile(os.path.join(self.path, old)):
                    os.remove(os.path.join(self.path, old))
        for at, name in files:
            os.replace(at, os.path.join(self.path, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(os.path.join(self.path, "_unfinished", self.job), ignore_errors=True)
        if os.path.isdir(top := os.path.join(self.path, "_unfinished")) and not os.listdir(top):
            os.rmdir(top)
