"""Sitemaps record by record: items come out before a file ends, limits are checked on the way.

XML goes chunk by chunk through an event parser and text line by line, so that what is held of a file is a chunk and an
item, however large it is.  A file ends at its first fault; the items before it stay.  `records()` takes bodies
that are rows already, the data source `sitemap_files` reads a folder of files, packed ones (.gz) too.
"""

from __future__ import annotations

import codecs
import io
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gossamer.sources.sitemaps import MAX_BYTES, MAX_LINES, NAMESPACE

#: kind: urlset, sitemapindex or text; item: place in the file (of a text: the line), of a fault that of what is missing.
RECORD = "kind string, item long, loc string, lastmod string, changefreq string, priority string, fault string"
FIELDS = ("loc", "lastmod", "changefreq", "priority")
INVALID, NO_ROOT, TOO_LARGE = "invalid sitemap", "no sitemap root", "sitemap is too large"
CHUNK_BYTES, BATCH_ROWS = 1 << 20, 4096
_ITEMS = {"urlset": "url", "sitemapindex": "sitemap"}


class _Fault(Exception):
    pass


class _Items:
    """Handlers of an event parser that put the items of a urlset or an index into `found`."""

    def __init__(self):
        self.kind, self.found, self.number = None, [], 0
        self._depth, self._item, self._field, self._text = 0, None, None, []

    def doctype(self, *_) -> None:
        raise _Fault(INVALID)  # sitemaps have none, and entities could blow up

    def start(self, name: str, _) -> None:
        space, _, local = name.rpartition(" ")
        own = space == NAMESPACE
        if self.kind is None:
            if not own or local not in _ITEMS:
                raise _Fault(NO_ROOT)
            self.kind = local
        elif self._item is not None:
            self._depth += 1
            if self._depth == 1 and own and local in FIELDS and local not in self._item:
                self._field, self._text = local, []
        elif own and local == _ITEMS[self.kind]:
            self._item, self._depth = {}, 0

    def text(self, data: str) -> None:
        if self._field:
            self._text.append(data)

    def end(self, _) -> None:
        if self._item is None:
            return
        if self._depth == 0:
            self.found.append((self.kind, self.number, *map(self._item.get, FIELDS), None))
            self._item, self.number = None, self.number + 1
            return
        if self._depth == 1 and self._field:
            self._item[self._field], self._field = "".join(self._text).strip(), None
        self._depth -= 1


def xml_records(chunks: Iterable[bytes], encoding: str | None = None) -> Iterator[tuple]:
    """RECORD rows of an XML file; the parser finds the encoding if none is given."""
    items, parser = _Items(), expat.ParserCreate(encoding, " ")
    parser.buffer_text = True
    parser.StartDoctypeDeclHandler, parser.CharacterDataHandler = items.doctype, items.text
    parser.StartElementHandler, parser.EndElementHandler = items.start, items.end
    fault = None
    for chunk, last in itertools.chain(((c, False) for c in chunks), [(b"", True)]):
        try:
            parser.Parse(chunk, last)
        except expat.ExpatError:
            fault = INVALID
        except _Fault as e:
            fault = str(e)
        yield from items.found
        items.found.clear()
        if fault:
            yield items.kind, items.number, None, None, None, None, fault
            return


def text_records(chunks: Iterable[bytes], max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> Iterator[tuple]:
    """RECORD rows of a text file of one URL a line; blank lines do not count, the byte limit ends at the last whole line."""
    newlines = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8-sig")("replace"), translate=True)
    rest, number, filled, size = "", 0, 0, 0
    for chunk, last in itertools.chain(((c, False) for c in chunks), [(b"", True)]):
        room, size = max_bytes - size, size + len(chunk)
        lines = (rest + newlines.decode(chunk[:room] if len(chunk) > room else chunk, last)).split("\n")
        rest = lines.pop()
        if last:
            lines.append(rest)
        for line in lines:
            if line := line.strip():
                filled += 1
                if filled > max_lines:
                    yield "text", number, None, None, None, None, TOO_LARGE
                    return
                yield "text", number, line, None, None, None, None
            number += 1
        if size > max_bytes:
            yield "text", number, None, None, None, None, TOO_LARGE
            return


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


_TYPES = {"string": pa.string(), "long": pa.int64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def records(files: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(site, RECORD) of `files` (site, content_type, body); bodies of text/plain are lines, others XML, null is empty."""
    ddl = "site string, " + RECORD
    schema = _schema(ddl)

    def of_file(site: str, kind: str, body: str) -> Iterator[tuple]:
        data = memoryview(body.encode("utf-8", "replace"))
        chunks = (bytes(data[i : i + CHUNK_BYTES]) for i in range(0, len(data), CHUNK_BYTES))
        found = text_records(chunks, max_lines, max_bytes) if kind == "text/plain" else xml_records(chunks, "utf-8")
        return ((site, *row) for row in found)

    def run(batches):
        rows = (row for b in batches for i in range(b.num_rows) for row in of_file(*(c[i].as_py() for c in b.columns)))
        return _batches(rows, schema)

    return files.select(F.col("site").cast("string").alias("site"), F.coalesce("content_type", F.lit("")).alias("content_type"), F.coalesce("body", F.lit("")).alias("body")).mapInArrow(run, ddl)


@dataclass
class Files(InputPartition):
    paths: list[str]


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.limits = int(options.get("max_lines", MAX_LINES)), int(options.get("max_bytes", MAX_BYTES))
        self.chunk, self.share = int(options.get("chunk_bytes", CHUNK_BYTES)), int(options.get("partition_bytes", 64 << 20))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:"))

    def partitions(self) -> list[Files]:
        """Small files share a partition; a file is read by one task, since its parts do not tell where items begin."""
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        parts, size = [], self.share
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
            if size + f.size > self.share:
                parts, size = [*parts, Files([])], 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()

        def rows():
            for path in partition.paths:
                with store.open_input_stream(path) as f:
                    chunks = iter(lambda f=f: f.read(self.chunk), b"")
                    is_text = path.removesuffix(".gz").endswith(".txt")
                    for row in text_records(chunks, *self.limits) if is_text else xml_records(chunks):
                        yield path, *row

        return _batches(rows(), _schema(SitemapFiles.ROW))


class SitemapFiles(DataSource):
    """(file, RECORD) of every file below `path`: `.txt` lines, others XML, `.gz` unpacked.

    Options: path, max_lines, max_bytes, chunk_bytes, partition_bytes.
    """

    ROW = "file string, " + RECORD

    @classmethod
    def name(cls) -> str:
        return "sitemap_files"

    def schema(self) -> str:
        return self.ROW

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SitemapFiles)
