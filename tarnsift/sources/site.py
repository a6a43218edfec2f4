"""A web site as a Spark data source: folders of pages read in partitions, each by following its next links or cursors.

    spark.dataSource.register(SiteSource)
    spark.read.format("site").option("base", "https://host").option("starts", "/a,/b").load()

Every start is a folder: its page, the page that its next link or cursor leads to, and so on to the last, as one row a page. Folders are
dealt to partitions, as many as may ask the site at once. A page that is missing is a row with its status; a page
that was met before ends the folder, or is an error where cursors are followed (a server that repeats a cursor would never
end). With stamps, a page whose tag is known comes back unchanged, without its text.

Options: base; starts (comma-separated); next: link (a tag with rel=next), or cursor (JSON with the field nextCursor; the cursor is asked
for with ?cursor=); at_once (partitions, by default 4); timeout (seconds, by default 10); tries (of a request, by default 2); most_pages (of a
folder; by default there is no bound); stamps (a JSON object of path to tag).
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NEXT = re.compile(r"""<(?:a|link)\b[^>]*\brel\s*=\s*["']?next\b[^>]*>""", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*["']?([^"'\s>]+)""", re.I)


class RepeatedCursor(Exception):
    """A server gave a cursor that it had given before."""


@dataclass
class Folders(InputPartition):
    starts: list[str]


class SiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.base, self.starts = options["base"].rstrip("/"), [s.strip() for s in options["starts"].split(",") if s.strip()]
        self.by_cursor = {"link": False, "cursor": True}[options.get("next", "link")]
        self.at_once, self.timeout, self.tries = int(options.get("at_once", 4)), float(options.get("timeout", 10)), int(options.get("tries", 2))
        self.most = int(options["most_pages"]) if "most_pages" in options else None
        self.stamps = json.loads(options.get("stamps", "{}"))

    def partitions(self) -> list[Folders]:
        return [Folders(self.starts[k :: self.at_once]) for k in range(min(self.at_once, len(self.starts)))]

    def ask(self, path: str) -> tuple[int, str | None, str | None, int]:
        """(status, text, tag, requests) of a path; errors of the network are tried again, statuses are answers."""
        request = urllib.request.Request(self.base + path)
        if path in self.stamps:
            request.add_header("If-None-Match", self.stamps[path])
        for n in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return answer.status, answer.read().decode("utf-8", "replace"), answer.headers.get("ETag"), n
            except urllib.error.HTTPError as error:
                if error.code < 500 or n == self.tries:
                    return error.code, None, error.headers.get("ETag"), n
            except urllib.error.URLError:
                if n == self.tries:
                    raise
        raise ValueError("tries must be one at least")

    def after(self, start: str, path: str, text: str) -> str | None:
        """The path of the page that follows."""
        if self.by_cursor:
            cursor = json.loads(text).get("nextCursor")
            return None if cursor is None else f"{start}{'&' if '?' in start else '?'}cursor={urllib.parse.quote(str(cursor))}"
        found = _NEXT.search(text)
        href = _HREF.search(found[0]) if found else None
        if href is None:
            return None
        to = urllib.parse.urlsplit(urllib.parse.urljoin(self.base + path, href[1]))
        return to.path + (f"?{to.query}" if to.query else "")

    def read(self, partition: Folders) -> Iterator[tuple]:
        for start in partition.starts:
            path, seen, n, asked = start, set(), 0, 0
            while path is not None and (self.most is None or n < self.most):
                if path in seen:
                    if self.by_cursor:
                        raise RepeatedCursor(f"{self.base}{path}")
                    break
                seen.add(path)
                status, text, tag, tries = self.ask(path)
                n, asked = n + 1, asked + tries
                yield start, n, path, status, tag, text, asked
                path = self.after(start, path, text) if text is not None and status == 200 else None


class SiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return "folder string, n int, path string, status int, tag string, text string, requests int"

    def reader(self, schema) -> SiteReader:
        return SiteReader(dict(self.options))
