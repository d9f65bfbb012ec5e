"""A chain served over HTTP as a Spark data source, in batch and as a stream.

    spark.dataSource.register(ChainSource)
    spark.readStream.format("chain_rpc").option("url", "http://host:port").load()

Offsets are heights.  A micro-batch is cut into pages, one partition each; a page that lacks
a height fails its task, so no height is ever skipped.  Where the stream starts: after the
checkpointed height of the query, else `backfill` seconds before the head (below 0: at it).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlencode
from urllib.request import ProxyHandler, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewell.sources.retry import call, pauses

SCHEMA = "number long, ts long, hash string, parent_hash string, n_tx long, txs string"
MAX_PAGE = 2000


class Client:
    """Head, lower bound, ranges and single blocks of a chain server."""

    def __init__(self, url: str, timeout: float = 10.0, attempts: int = 5, jitter: float = 0.1) -> None:
        self.url, self.timeout, self.attempts, self.jitter = url.rstrip("/"), timeout, attempts, jitter

    def get(self, path: str, **params: Any) -> dict:
        query = f"?{urlencode(params)}" if params else ""

        def once() -> dict:
            with build_opener(ProxyHandler({})).open(f"{self.url}{path}{query}", timeout=self.timeout) as answer:
                return json.load(answer)

        return call(once, pauses(self.attempts, jitter=self.jitter))

    def head(self) -> dict:
        return self.get("/chain/head")

    def at_or_after(self, ts: int) -> dict:
        return self.get("/block/at-or-after", ts=ts)

    def blocks(self, start: int, end: int) -> dict:
        return self.get("/blocks/range", **{"from": start, "to": end})

    def by_number(self, number: int) -> dict:
        return self.get(f"/block/by-number/{number}")


class Page(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def pages(start: int, end: int, size: int) -> list[Page]:
    return [Page(k, min(k + size - 1, end)) for k in range(start, end + 1, size)]


def fetched(client: Client, page: Page) -> Iterator[tuple]:
    expected = page.start
    for b in client.blocks(page.start, page.end).get("blocks") or []:
        header = b["header"]
        if header["number"] < expected:
            continue
        if header["number"] > expected or expected > page.end:
            break
        txs = b.get("txs") or []
        yield (expected, header.get("timestamp", 0), b.get("hash"), header.get("parent_hash"), len(txs), json.dumps(txs))
        expected += 1
    if expected <= page.end:
        raise RuntimeError(f"height {expected} is missing")


class _Options:
    def __init__(self, options: dict) -> None:
        self.client = Client(options["url"])
        self.page = int(options.get("page", 200))
        if not 1 <= self.page <= MAX_PAGE:
            raise ValueError(f"page must be 1 to {MAX_PAGE}")
        self.per_batch = int(options.get("maxHeightsPerTrigger", 10 * self.page))
        self.backfill = int(options.get("backfill", 86_400))

    def first(self) -> int:
        head = self.client.head()
        if head.get("empty") or head.get("head_num", 0) <= 0:
            return 1
        if self.backfill < 0:
            return head["head_num"]
        return self.client.at_or_after(max(head["head_timestamp"] - self.backfill, 0))["block_num"]


class ChainReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = _Options(options)
        self.start, self.end = int(options.get("from", 1)), options.get("to")

    def partitions(self) -> list[Page]:
        top = self.options.client.head().get("head_num", 0)
        return pages(self.start, min(int(self.end or top), top), self.options.page)

    def read(self, partition: Page) -> Iterator[tuple]:
        return fetched(self.options.client, partition)


class ChainStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = _Options(options)
        self.reached: int | None = None

    def initialOffset(self) -> dict:
        return {"next": self.options.first()}

    def latestOffset(self) -> dict:
        if self.reached is None:
            self.reached = self.options.first()
        top = self.options.client.head().get("head_num", 0) + 1
        return {"next": max(min(top, self.reached + self.options.per_batch), self.reached)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.reached = max(self.reached or 0, end["next"])
        return pages(start["next"], end["next"] - 1, self.options.page)

    def read(self, partition: Page) -> Iterator[tuple]:
        return fetched(self.options.client, partition)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached or 0, end["next"])


class ChainSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chain_rpc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChainReader:
        return ChainReader(self.options)

    def streamReader(self, schema) -> ChainStream:
        return ChainStream(self.options)
