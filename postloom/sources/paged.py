"""A cursor-paged source: each page names the cursor of the next, and a stream's offset is the cursor.

Pages are landed as JSON files, `<folder>/<cursor>.json` (the first: `first.json`), each with its rows and the next cursor; a reader of another kind of page
gives its own `Pages`.  A batch read follows the cursors from one on (none: the first) to the end; a stream reads some pages a batch, and goes on from
its checkpoint's cursor after a restart.  The rows of a page are read where the page is opened, in a task, not in the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The cursor of the first page, and the offset after a last page.
FIRST, END = "first", ""
_SCHEMA = "user_id string, screen_name string, name string, page string"


class Pages:
    """The pages of a folder.  A missing page isn't there yet; blank cursors end a chain."""

    def __init__(self, folder: str, field: str) -> None:
        self.folder, self.field = folder, field

    def get(self, cursor: str) -> dict[str, Any] | None:
        if os.sep in cursor or cursor.startswith("."):
            raise ValueError(f"no cursor: {cursor!r}")
        try:
            with open(os.path.join(self.folder, f"{cursor}.json"), encoding="utf-8") as f:
                page = json.load(f)
        except FileNotFoundError:
            return None
        return page if isinstance(page, dict) else {}

    def after(self, cursor: str) -> str | None:
        """The next cursor, END after the last page, None while the page isn't there."""
        page = self.get(cursor)
        if page is None:
            return None
        next_ = page.get("next_cursor")
        return next_.strip() if isinstance(next_, str) and next_.strip() else END

    def rows(self, cursor: str) -> Iterator[dict[str, Any]]:
        found = (self.get(cursor) or {}).get(self.field)
        for row in found if isinstance(found, list) else []:
            if isinstance(row, dict):
                yield row


class Page(InputPartition):
    def __init__(self, cursor: str) -> None:
        super().__init__(cursor)
        self.cursor = cursor


def _tuples(pages: Pages, cursor: str, names: list[str]) -> Iterator[tuple]:
    for row in pages.rows(cursor):
        own = {**row, "page": cursor}
        yield tuple(x if isinstance(x, str) else None if x is None else str(x) for x in (own.get(n) for n in names))


class _Reader(DataSourceReader):
    def __init__(self, pages: Pages, start: str, names: list[str]) -> None:
        self.pages, self.start, self.names = pages, start, names

    def partitions(self) -> list[Page]:
        """Cursors of the chain, a task a page; a cursor that comes again ends it."""
        found: dict[str, None] = {}
        cursor: str | None = self.start
        while cursor and cursor not in found and (after := self.pages.after(cursor)) is not None:
            found[cursor] = None
            cursor = after
        return [Page(c) for c in found]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _tuples(self.pages, partition.cursor, self.names)


class _StreamReader(DataSourceStreamReader):
    """Offsets name the cursor to read next, and how many pages came before."""

    def __init__(self, pages: Pages, start: str, names: list[str], most: int) -> None:
        self.pages, self.start, self.names, self.most = pages, start, names, max(1, most)
        self.at: dict[str, Any] | None = None

    def initialOffset(self) -> dict[str, Any]:
        return {"cursor": self.start, "pages": 0}

    def _chain(self, offset: dict[str, Any], most: int) -> Iterator[tuple[str, dict[str, Any]]]:
        """Each page from the offset on, and the offset after it."""
        cursor, n = offset["cursor"], offset["pages"]
        for _ in range(most):
            after = self.pages.after(cursor) if cursor else None
            if after is None:
                return
            n += 1
            yield cursor, {"cursor": after, "pages": n}
            cursor = after

    def latestOffset(self) -> dict[str, Any]:
        at = self.at or self.initialOffset()
        for _, at in self._chain(at, self.most):
            pass
        self.at = at
        return at

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[Page]:
        # after a restart Spark names the offsets; what follows goes on from there
        if self.at is None or self.at["pages"] < end["pages"]:
            self.at = end
        return [Page(cursor) for cursor, _ in self._chain(start, end["pages"] - start["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _tuples(self.pages, partition.cursor, self.names)

    def commit(self, end: dict[str, Any]) -> None:
        pass


class CursorPages(DataSource):
    """Format `cursor_pages`: options path, field (the list of rows in a page; members), cursor (to start at) and pages (of a batch of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return _SCHEMA

    def _parts(self, schema: StructType) -> tuple[Pages, str, list[str]]:
        return Pages(self.options["path"], self.options.get("field", "members")), self.options.get("cursor", FIRST), schema.names

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._parts(schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(*self._parts(schema), int(self.options.get("pages", "10")))
