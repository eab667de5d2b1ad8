"""Published reports: a page a report and a line in an index, written by tasks and put in place by the commit.

Tasks write pages beside their places; the commit moves them there and then replaces the index in one step, so a failed write leaves the old pages and index as they were,
and a write that is repeated replaces its pages and lines instead of doubling them.  The folder is one that all machines share.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

INDEX = "README.md"
#: Fixed value: the first line of an index.
HEADER = "# Daily Reports"


def file_name(day: str, report_id: str) -> str:
    return f"{day}-{report_id[:8]}.md"


def entry(day: str, headline: str, file: str) -> str:
    """The report's line of the index."""
    line = headline.replace("\r\n", " ").replace("\n", " ").strip()
    return f"- {day} | {line} ([view](./{file}))"


def indexed(old: str | None, entries: dict[str, str]) -> str:
    """The index with an entry for each file: in the place of the file's own line, if there is one, or else before the first entry."""
    lines = old.replace("\r\n", "\n").split("\n") if old else [HEADER, ""]
    if not lines[0].startswith("#"):
        lines[:0] = [HEADER, ""]
    if len(lines) > 1 and lines[1].strip():
        lines.insert(1, "")
    for file, line in entries.items():
        own = next((i for i, x in enumerate(lines) if f"./{file}" in x), None)
        if own is not None:
            lines[own] = line
        else:
            at = next((i for i, x in enumerate(lines) if x.strip().startswith("- ")), len(lines))
            lines.insert(at, line)
    return "\n".join(lines).rstrip() + "\n"


@dataclass
class _Written(WriterCommitMessage):
    pages: list[tuple[str, str, str]]  #: where a page was written, its file and its entry


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, fields: list[str]) -> None:
        self.folder, self.fields, self.run = folder, fields, uuid.uuid4().hex

    def _beside(self) -> str:
        return os.path.join(self.folder, f".writing-{self.run}")

    def write(self, rows: Iterator[Row]) -> _Written:
        os.makedirs(self._beside(), exist_ok=True)
        pages = []
        for row in rows:
            r = dict(zip(self.fields, row, strict=True))
            if not r["report_id"] or not r["day"]:
                raise ValueError("a report needs an id and a day")
            file = file_name(r["day"], r["report_id"])
            if os.sep in file:
                raise ValueError(f"no file name: {file!r}")
            path = os.path.join(self._beside(), f"{uuid.uuid4().hex}.md")
            with open(path, "w", encoding="utf-8") as f:
                f.write((r["content"] or "").rstrip() + "\n")
            pages.append((path, file, entry(r["day"], r["headline"] or "", file)))
        return _Written(pages)

    def commit(self, messages: list[_Written | None]) -> None:
        # in the order of the files' names, so that the newest day stands first
        pages = sorted((file, path, line) for m in messages if m for path, file, line in m.pages)
        if pages:
            os.makedirs(self.folder, exist_ok=True)
            for file, path, _ in pages:
                os.replace(path, os.path.join(self.folder, file))
            index = os.path.join(self.folder, INDEX)
            old = None
            if os.path.exists(index):
                with open(index, encoding="utf-8") as f:
                    old = f.read()
            new = os.path.join(self._beside(), INDEX)
            with open(new, "w", encoding="utf-8") as f:
                f.write(indexed(old, {file: line for file, _, line in pages}))
            os.replace(new, index)
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if os.path.isdir(self._beside()):
            for name in os.listdir(self._beside()):
                os.unlink(os.path.join(self._beside(), name))
            os.rmdir(self._beside())


class ReportPages(DataSource):
    """Format `report_pages`, option path: writes report_id, day (YYYY-MM-DD), headline and content."""

    @classmethod
    def name(cls) -> str:
        return "report_pages"

    def schema(self) -> str:
        return "report_id string, day string, headline string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"report_id", "day", "headline", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return _Writer(self.options["path"], schema.names)
