"""Pages of live servers as a data source of Spark, for batches and streams.

`write_batch()` puts URLs into numbered folders, each file of which holds all URLs of its sites; a file is a
partition, so that the delay between two requests to a site holds inside a task, and a lost task asks for its file
again.  `spark.read.format("web_pages").load(folder)` fetches all of them; as a stream the source's offset is the
number of complete folders, so that a query goes on where its checkpoint says.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gossamer.functions.urls import authority

RESPONSE = "url string, status int, content_type string, body string, error string"
#: What a server may answer that is worth another try.
AGAIN = (429, 500, 502, 503, 504)


def fetch_one(url: str, headers: dict[str, str], timeout: float = 30.0, retries: int = 0, backoff: float = 0.5) -> tuple:
    """A RESPONSE row.  Errors of the connection and AGAIN are tried again, `backoff` seconds later and twice as long
    each time, or as long as Retry-After says, up to a minute."""
    import urllib.error
    import urllib.parse
    import urllib.request

    address = urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~")
    for turn in range(retries + 1):
        wait = min(60.0, backoff * 2**turn)
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=timeout) as r:
                charset = r.headers.get_content_charset() or "utf-8"
                return url, r.status, r.headers.get_content_type(), r.read().decode(charset, "replace"), None
        except urllib.error.HTTPError as e:
            row = url, e.code, e.headers.get_content_type(), "", None
            if e.code not in AGAIN:
                return row
            asked = e.headers.get("Retry-After", "")
            wait = min(60.0, float(asked)) if asked.isdecimal() else wait
        except (OSError, LookupError) as e:
            row = url, None, None, None, str(e)
        except ValueError as e:  # no URL at all
            return url, None, None, None, str(e)
        if turn < retries:
            time.sleep(wait)
    return row


def fetch_all(urls: Iterable[tuple[str, str, float]], headers: dict[str, str], timeout: float = 30.0, retries: int = 0, backoff: float = 0.5) -> Iterator[tuple]:
    """RESPONSE rows of (url, site, delay), one after the other; the delay passes between requests to a site."""
    ready: dict[str, float] = {}
    for url, site, delay in urls:
        if delay > 0:
            time.sleep(max(0.0, ready.get(site, 0.0) - time.monotonic()))
            ready[site] = time.monotonic() + delay
        yield fetch_one(url, headers, timeout, retries, backoff)


def write_batch(urls: DataFrame, folder: str, number: int, files: int = 8) -> None:
    """Writes `urls` (url) as batch `number` (from 0, without gaps); writing it again replaces it."""
    spread = urls.select("url", authority(F.col("url")).alias("site")).repartition(files, "site")
    spread.select("url").write.mode("overwrite").text(f"{folder}/batch={number:08d}")


@dataclass
class UrlFile(InputPartition):
    path: str


class _Fetching:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.headers = {k: v for k, v in (("User-Agent", options.get("user_agent")), ("Cookie", options.get("cookie"))) if v}
        self.delay, self.timeout = float(options.get("delay", 0)), float(options.get("timeout", 30))
        self.retries, self.backoff = int(options.get("retries", 2)), float(options.get("backoff", 0.5))

    def _store(self):
        from pyarrow import fs

        path = self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:")
        return fs.FileSystem.from_uri(path)

    def batches(self) -> int:
        """How many folders are complete, without gaps."""
        from pyarrow import fs

        store, root = self._store()
        number = 0
        while store.get_file_info(f"{root}/batch={number:08d}/_SUCCESS").type == fs.FileType.File:
            number += 1
        return number

    def files(self, begin: int, end: int) -> list[UrlFile]:
        from pyarrow import fs

        store, root = self._store()
        found = []
        for number in range(begin, end):
            inside = store.get_file_info(fs.FileSelector(f"{root}/batch={number:08d}"))
            found += sorted(f.path for f in inside if f.base_name.startswith("part-") and f.size)
        return [UrlFile(path) for path in found]

    def read(self, partition: UrlFile) -> Iterator[tuple]:
        store, _ = self._store()
        with store.open_input_stream(partition.path) as f:
            lines = f.read().decode().splitlines()
        site = lambda url: "/".join(url.split("/", 3)[:3])
        yield from fetch_all(((url, site(url), self.delay) for url in lines), self.headers, self.timeout, self.retries, self.backoff)


class _Reader(_Fetching, DataSourceReader):
    def partitions(self) -> list[UrlFile]:
        return self.files(0, self.batches())


class _StreamReader(_Fetching, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": self.batches()}

    def partitions(self, start: dict, end: dict) -> list[UrlFile]:
        return self.files(start["batches"], end["batches"])

    def commit(self, end: dict) -> None:
        pass


class WebPages(DataSource):
    """Options: path, user_agent, cookie, delay, timeout, retries, backoff."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
