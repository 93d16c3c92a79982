"""Paged services as a Spark source: a partition a symbol or shard of symbols, whose pages are fetched one after the other on an executor."""

from __future__ import annotations

import heapq
import io
import json
import zlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.session import written
from .bars import fetch_pages

FIRST = "first"


class FolderService:
    """A service that answers from files: those of <root>/shards=<n>/shard=<k>/ hold a line of JSON (symbol, token, body) for each page.

    A symbol is in the shard that crc32 of its name gives (0 for null), and each file is sorted by symbol, so a shard of
    many symbols is read once, a symbol at a time. The root may lie in any store that pyarrow reads. The pages of the
    symbol asked for last are kept.
    """

    def __init__(self, root: str):
        from pyarrow import fs

        plain = root.removeprefix("file://").removeprefix("file:") if root.startswith("file:") else root
        self.files, self.root = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
        self.symbol, self.pages, self.count = None, None, None

    def _shard_count(self) -> int:
        from pyarrow import fs

        if self.count is None:
            found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
            self.count = max((int(x.base_name.removeprefix("shards=")) for x in found if x.base_name.startswith("shards=")), default=0)
        return self.count

    def shards(self) -> list[int]:
        return list(range(self._shard_count()))

    def symbols(self) -> list[str]:
        return sorted(symbol for shard in self.shards() for symbol in self.symbols_of(shard) if symbol is not None)

    def _lines(self, path: str) -> Iterator[dict]:
        with io.TextIOWrapper(io.BufferedReader(self.files.open_input_stream(path)), "utf-8", newline="\n") as lines:
            yield from (json.loads(line) for line in lines if line != "\n")

    def _grouped(self, shard: int) -> Iterator[tuple[str | None, dict]]:
        """The symbols of a shard in their order, each with its bodies by token."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/shards={self._shard_count()}/shard={shard}", allow_not_found=True))
        place = lambda x: (x.get("symbol") is not None, x.get("symbol") or "")
        merged = heapq.merge(*(self._lines(x.path) for x in found if x.is_file and not x.base_name.startswith(("_", "."))), key=place)
        for (named, symbol), rows in groupby(merged, place):
            yield symbol if named else None, {x["token"]: x["body"] for x in rows}

    def symbols_of(self, shard: int) -> Iterator[str | None]:
        """The symbols of a shard; each one's pages are at hand until the next is taken."""
        for self.symbol, self.pages in self._grouped(shard):
            yield self.symbol

    def fetch(self, symbol: str, token: str | None) -> tuple[str, str | None]:
        """The body of a page and the token of the next one."""
        if symbol != self.symbol or self.pages is None:
            shard = zlib.crc32((symbol or "").encode()) % max(self._shard_count(), 1)
            self.symbol, self.pages = symbol, next((pages for found, pages in self._grouped(shard) if found == symbol), {})
        if (token or FIRST) not in self.pages:
            raise FileNotFoundError(f"{symbol} has no page {token or FIRST}")
        body = self.pages[token or FIRST]
        return body, json.loads(body).get("next_page_token")


class SymbolPartition(InputPartition):
    def __init__(self, symbols: list[str] | None = None, shard: int | None = None):
        self.symbols, self.shard = symbols or [], shard


class PagedReader(DataSourceReader):
    def __init__(self, source: PagedSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        """One for each symbol, or each few, that was asked for; where none was, one for each shard of the service, or for all symbols that it names."""
        asked, few = self.source.options.get("symbols"), self.source.options.get("symbols_per_task")
        service = self.source.service()
        if asked is None and few is None and hasattr(service, "shards"):
            return [SymbolPartition(shard=k) for k in service.shards()] or [SymbolPartition()]
        symbols = list(dict.fromkeys(json.loads(asked) if asked else service.symbols()))
        each = int(few or 1)
        return [SymbolPartition(symbols[at : at + each]) for at in range(0, len(symbols), each)] or [SymbolPartition()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        service = self.source.service() if partition.symbols or partition.shard is not None else None
        for symbol in partition.symbols if partition.shard is None else service.symbols_of(partition.shard):
            yield from self._pages(service, symbol)

    def _pages(self, service, symbol: str) -> Iterator[tuple]:
        number = 0
        try:
            for body in fetch_pages(lambda token: service.fetch(symbol, token), int(self.source.options.get("most_pages", 100))):
                yield symbol, number, body, None
                number += 1
        except FileNotFoundError:
            yield symbol, number, None, "NO_DATA"
        except json.JSONDecodeError:
            yield symbol, number, None, "RESPONSE_SCHEMA_INVALID"
        except ValueError:  # a token that came before, or too many pages
            yield symbol, number, None, "PAGINATION_INVALID"


class PagedSource(DataSource):
    """Format ``tidemark_pages``: (symbol, page, body, problem), a row a page, and one of a problem where the pages break off.

    Options: path, the service's root; symbols, a JSON list; most_pages, 100 by default; symbols_per_task. A service with
    ``shards()`` and ``symbols_of(shard)`` gets a task a shard, so neither the driver nor a task holds the list of all its
    symbols; symbols that were asked for, and those of other services, get a task each, or one for ``symbols_per_task``.
    Subclasses answer from another service by overriding ``name`` and ``service``, which has to give something with
    ``symbols()`` and ``fetch(symbol, token)``.
    A task fetches a symbol's pages in order, as each token comes with the page before, and holds one page at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def schema(self) -> str:
        return "symbol string, page int, body string, problem string"

    def service(self):
        return FolderService(self.options["path"])

    def reader(self, schema) -> PagedReader:
        return PagedReader(self)


def read_service(spark: SparkSession, path: str, symbols: list[str] | None = None, most_pages: int = 100, symbols_per_task: int | None = None, source: type[PagedSource] = PagedSource) -> DataFrame:
    """The pages of the symbols of a service."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path).option("most_pages", most_pages)
    if symbols_per_task is not None:
        reader = reader.option("symbols_per_task", symbols_per_task)
    return (reader if symbols is None else reader.option("symbols", json.dumps(symbols))).load()


#: About so many pages make a shard.
SHARD_PAGES = 2_048


def write_service(pages: DataFrame, path: str) -> None:
    """Writes pages (symbol, token, body) for ``FolderService``; the first one's token is null. Pages are counted first: shards grow in number, not in size."""
    from pyspark.sql import functions as F

    kept = written(pages.select("symbol", "token", "body"))
    shards = -(-kept.count() // SHARD_PAGES) or 1
    line = F.to_json(F.struct("symbol", F.coalesce("token", F.lit(FIRST)).alias("token"), "body")).alias("value")
    rows = kept.select("symbol", F.crc32(F.coalesce("symbol", F.lit("")).cast("binary")).alias("_hash"), line).withColumn("shard", (F.col("_hash") % shards).cast("int"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "symbol").select("value", F.lit(shards).alias("shards"), "shard")
    rows.write.partitionBy("shards", "shard").text(path)
