"""A Python data source of discovery pages: a batch reader with a partition for each provider and variant, and a stream reader by rounds.

Pages are recorded in rounds, ``<path>/page-<k>/<provider>/<slug of the variant>`` with the mark ``_SUCCESS`` once round k
is complete, on any file system that pyarrow opens. A caller that asks a service instead names a function,
``fetch="module:function"``, of (provider, variant, offset, page_limit) that returns the page's text or raises.

Options: path or fetch, variants (JSON list), limit, page_size. Rows: provider, variant, offset, page_limit, payload, n. A
provider's pages end at the first that fails, is empty or is short, so each partition pages by itself. The
stream's offset is the number of rounds read; a round is read once, and only for variants whose earlier pages were full.
"""

from __future__ import annotations

import importlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.durable import ship
from ..operators.discovery import LARGEST_PAGE, PROVIDERS

SCHEMA = "provider string, variant string, offset int, page_limit int, payload string, n int"


def slug(variant: str) -> str:
    return re.sub("[^a-z0-9]+", "-", variant.lower()).strip("-")


def results_of(provider: str, payload: str) -> int:
    """How many results a page holds."""
    if provider == "arxiv":
        return len(re.findall(r"<entry[\s>]", payload))
    page = json.loads(payload)
    return len(page.get("results") or (page.get("esearchresult") or {}).get("idlist") or [])


@dataclass
class Paged(InputPartition):
    """The pages of one variant of a provider; of a stream, those of the rounds from ``first`` to before ``end``."""

    provider: str
    variant: str
    total: int
    first: int = 0
    end: int | None = None


class _Pages:
    """What both readers share."""

    def __init__(self, options: dict):
        self.path, self.fetch = options.get("path"), options.get("fetch")
        self.size = max(1, min(int(options.get("page_size", LARGEST_PAGE)), LARGEST_PAGE))
        self.variants, limit = json.loads(options.get("variants", "[]")), max(0, int(options.get("limit", 0)))
        self.quotas = {p: limit // len(PROVIDERS) + (k < limit % len(PROVIDERS)) for k, p in enumerate(PROVIDERS)}
        if bool(self.path) == bool(self.fetch):
            raise ValueError("discovery takes either a path of recorded pages or a function that fetches them")

    def partitions_of(self, first: int = 0, end: int | None = None) -> list[Paged]:
        each = {p: max(1, math.ceil(q / max(1, len(self.variants)))) if q > 0 else 0 for p, q in self.quotas.items()}
        return [Paged(p, v, n, first, end) for p, n in each.items() for v in self.variants if n > first * self.size]

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def rounds(self) -> int:
        """Complete rounds from the first one on."""
        from pyarrow import fs

        system, root = self._files()
        k = 0
        while system.get_file_info(f"{root}/page-{k}/_SUCCESS").type == fs.FileType.File:
            k += 1
        return k

    def _page(self, provider: str, variant: str, offset: int, page_limit: int) -> str:
        if self.fetch:
            module, name = self.fetch.split(":")
            return getattr(importlib.import_module(module), name)(provider, variant, offset, page_limit)
        system, root = self._files()
        with system.open_input_stream(f"{root}/page-{offset // self.size}/{provider}/{slug(variant)}") as f:
            return f.read().decode("utf-8")

    def pages(self, part: Paged) -> Iterator[tuple]:
        end = math.ceil(part.total / self.size) if part.end is None else min(part.end, math.ceil(part.total / self.size))
        for k in range(end):
            offset = k * self.size
            page_limit = min(self.size, part.total - offset)
            try:
                payload = self._page(part.provider, part.variant, offset, page_limit)
                n = results_of(part.provider, payload)
            except Exception:  # a page that fails ends its variant, as an empty one does; others go on
                return
            if not n:
                return
            if k >= part.first:
                yield part.provider, part.variant, offset, page_limit, payload, n
            if n < page_limit:
                return


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Paged]:
        return self.partitions_of()

    def read(self, partition: Paged) -> Iterator[tuple]:
        return self.pages(partition) if isinstance(partition, Paged) else iter(())


class _Stream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": self.rounds()}

    def partitions(self, start: dict, end: dict) -> list[Paged]:
        return self.partitions_of(start["round"], end["round"])

    def read(self, partition: Paged) -> Iterator[tuple]:
        return self.pages(partition) if isinstance(partition, Paged) else iter(())

    def commit(self, end: dict) -> None:
        pass


class DiscoverySource(DataSource):
    """``register(spark)``, then ``format("discovery")`` to read or readStream."""

    @classmethod
    def name(cls) -> str:
        return "discovery"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "fetch" in self.options:
            raise ValueError("a stream reads recorded rounds; give it a path")
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and its code to the executors."""
    ship(spark)
    spark.dataSource.register(DiscoverySource)
