"""Chunks of a log kept by an HTTP server, as a Python data source named ``remote_chunks``.

``GET url?offset=T`` answers with a JSON array of events, the token to go on from in the
header ``Stream-Next-Offset``, and ``Stream-Up-To-Date: true`` at the tail; ``HEAD``
gives the tail's token.  With the option ``live`` the server holds the request until
there is something new.

Rows are whole chunks in the order of ``seq``; ``chunks.decode_chunks`` makes events of
them on the executors.  Tokens are opaque: each is known only from the chunk before
it, so that fetching is one sequential reader by nature.  Chunks without events are
rows too, and reading goes on behind them; it ends where the server says that it is up
to date or does not advance.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from logtide.functions.offsets import NEWEST, OLDEST
from logtide.sources.chunks import CHUNK_SCHEMA, decode_chunks

# The protocol's names.
ZERO_OFFSET, NEXT_OFFSET, UP_TO_DATE = "-1", "Stream-Next-Offset", "Stream-Up-To-Date"

REMOTE_SCHEMA = "seq long, " + CHUNK_SCHEMA


class RemoteError(RuntimeError):
    """A request that failed for good, or too often."""


class Client:
    def __init__(self, options: dict[str, str]):
        # data source options are case-insensitive; Spark hands them over in lower case
        self.url, self.attempts = options["url"], int(options.get("attempts", 3))
        self.timeout, self.pause = float(options.get("timeout", 30)), float(options.get("pause", 0.1))
        self.live = str(options.get("live", "false")).lower() == "true"

    def _request(self, method: str, **query: str) -> tuple[dict, str]:
        parts = urllib.parse.urlsplit(self.url)
        query = urllib.parse.urlencode(urllib.parse.parse_qsl(parts.query) + list(query.items()))
        url = urllib.parse.urlunsplit(parts._replace(query=query))
        for k in range(self.attempts):
            if k:
                time.sleep(min(self.pause * 2 ** (k - 1), 30))
            try:
                with urllib.request.urlopen(urllib.request.Request(url, method=method), timeout=self.timeout) as answer:
                    return dict(answer.headers), answer.read().decode("utf-8")
            except urllib.error.HTTPError as e:
                last = e
                if e.code != 429 and e.code < 500:
                    break
            except OSError as e:  # refused, reset, timed out
                last = e
        raise RemoteError(f"{method} {url}: {last}")

    def tail(self) -> str:
        return _header(self._request("HEAD")[0], NEXT_OFFSET, "")

    def resolve(self, start: str) -> str:
        return self.tail() if start == NEWEST else start

    def chunks(self, start: str, seq: int = 0, live: bool = False) -> Iterator[tuple]:
        """Chunks behind a token, up to the tail; rows of ``REMOTE_SCHEMA``.  Only the first request is held by a ``live`` server."""
        while True:
            query = {"offset": ZERO_OFFSET if start == OLDEST else start} | ({"live": "long-poll"} if live else {})
            headers, body = self._request("GET", **query)
            to = _header(headers, NEXT_OFFSET, start)
            done = _header(headers, UP_TO_DATE, "").lower() == "true"
            yield seq, start, to, done, body or "[]"
            if done or to == start:
                return
            start, seq, live = to, seq + 1, False


def _header(headers: dict, name: str, default: str) -> str:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), default)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client, self.start = Client(options), options.get("start", OLDEST)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.client.resolve(self.start))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.client.chunks(partition.value)


class _Stream(SimpleDataSourceStreamReader):
    """A micro-batch holds at most ``chunks_per_trigger`` chunk bodies on the driver (default 16)."""

    def __init__(self, options: dict[str, str]):
        self.client, self.start, self.most = Client(options), options.get("start", OLDEST), int(options.get("chunks_per_trigger", 16))

    def initialOffset(self) -> dict:
        return {"offset": self.client.resolve(self.start), "seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for row in self.client.chunks(start["offset"], start["seq"], self.client.live):
            if row[2] == row[1]:
                break  # no advance: nothing to hand on, and the offset must stay
            rows.append(row)
            end = {"offset": row[2], "seq": row[0] + 1}
            if len(rows) == self.most:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for row in self.client.chunks(start["offset"], start["seq"]):
            if row[0] >= end["seq"]:
                return
            # the chunk may have grown since: what lies behind the batch's end comes with the next batch again
            yield row
            if row[2] == end["offset"]:
                return

    def commit(self, end: dict) -> None: ...


class RemoteChunks(DataSource):
    """Options: ``url``; ``start`` (a token, "" for the start, "$" for the tail), ``attempts``, ``timeout``, ``pause``, ``live``, ``chunks_per_trigger``."""

    @classmethod
    def name(cls) -> str:
        return "remote_chunks"

    def schema(self) -> str:
        return REMOTE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def _loaded(spark: SparkSession, reader, url: str, options: dict) -> DataFrame:
    spark.dataSource.register(RemoteChunks)
    return reader.format(RemoteChunks.name()).options(url=url, **options).load()


def read_chunks(spark: SparkSession, url: str, **options) -> DataFrame:
    """Chunks up to the tail."""
    return _loaded(spark, spark.read, url, options)


def read_events(spark: SparkSession, url: str, **options) -> DataFrame:
    """Events up to the tail, with ``chunk_start`` and ``member``."""
    return decode_chunks(read_chunks(spark, url, **options))


def tail_chunks(spark: SparkSession, url: str, **options) -> DataFrame:
    """Chunks as a stream that follows the server; ``live`` lets it push."""
    return _loaded(spark, spark.readStream, url, options)
