"""Review pages from services that are read page by page, as a data source for batches and streams.

A fetcher is injected: ``fetch(app, country, token)`` gives the page's body and the token of the next page, or None after the
last. The first page's token is None. Every (app, country) is a partition of its own, in which pages follow one
another. Rows are pages as they came (app_id, country, page, body, error); ``stores`` takes reviews out of bodies.

A page that fails is tried ``attempts`` times with pauses that double. In a batch the feed ends there, with the error in a
row without a body. In a stream it is tried again in the next rounds, up to ``rounds`` of them, and then given up so.

A stream goes in rounds of ``batch_pages`` pages for each feed. Where a feed stands after a round is one small file in the
ledger, a folder that all executors share: round k goes on from the token in the entry of round k - 1, so a round that is run
again reads the same pages again, and a stream that was stopped goes on at each feed's own token. An entry's name
says whether there is more, so that the driver lists names and opens nothing.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators.calls import retried

Fetch = Callable[[str, str, "str | None"], "tuple[str, str | None]"]
SCHEMA = "app_id string, country string, page int, body string, error string"


class Ledger:
    """Where each feed stands after each round: {"token", "page", "failed"} in ``round=k/<feed>.more`` or ``.done``."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def _at(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def names(self, n: int) -> dict[str, str]:
        """Feeds with an entry of this round, and ``more`` or ``done``."""
        from pyarrow import fs

        files, root = self._at()
        found = files.get_file_info(fs.FileSelector(f"{root}/round={n}", allow_not_found=True))
        return dict(f.base_name.split(".", 1) for f in found if f.base_name.endswith((".more", ".done")))

    def last(self) -> int:
        from pyarrow import fs

        files, root = self._at()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return max((int(f.base_name.removeprefix("round=")) for f in found if f.base_name.startswith("round=")), default=0)

    def read(self, n: int, feed: str) -> dict:
        if not n:
            return {"token": None, "page": 0, "failed": 0}
        files, root = self._at()
        with files.open_input_stream(f"{root}/round={n}/{feed}.more") as f:
            return json.loads(f.read())

    def put(self, n: int, feed: str, entry: dict, more: bool) -> None:
        files, root = self._at()
        files.create_dir(f"{root}/round={n}", recursive=True)
        draft, other = f"{root}/round={n}/{feed}.{time.time_ns()}", f"{root}/round={n}/{feed}.{'done' if more else 'more'}"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps(entry).encode())
        files.move(draft, f"{root}/round={n}/{feed}.{'more' if more else 'done'}")
        if files.get_file_info(other).is_file:  # of a run of this round that was stopped
            files.delete_file(other)


class Feed(InputPartition):
    def __init__(self, app: str, country: str, after: int = 0) -> None:
        super().__init__((app, country, after))
        self.app, self.country, self.after = app, country, after

    @property
    def name(self) -> str:
        return hashlib.sha1(json.dumps([self.app, self.country]).encode()).hexdigest()


class _Pages:
    def __init__(self, fetch: Fetch, options: dict) -> None:
        self.fetch = fetch
        self.feeds = [tuple(map(str, f)) for f in json.loads(options["feeds"])]
        self.pages = int(options.get("pages", 10))
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 0.5))
        self.rounds, self.batch_pages = int(options.get("rounds", 3)), int(options.get("batch_pages", 1))
        self.ledger = Ledger(options["ledger"]) if "ledger" in options else None

    def some(self, app: str, country: str, token: str | None, page: int, most: int) -> Iterator[tuple]:
        """(page, body, error, next token) of up to ``most`` pages from a token on; the last one may be an error."""
        while most > 0 and page < self.pages:
            try:
                body, following = retried(lambda t=token: self.fetch(app, country, t), self.attempts, self.pause)
            except Exception as e:
                yield page, None, f"{type(e).__name__}: {e}", token
                return
            yield page, body, None, following
            token, page, most = following, page + 1, most - 1
            if token is None:
                return


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [Feed(*f) for f in self.feeds]

    def read(self, partition: Feed) -> Iterator[tuple]:
        for page, body, error, _ in self.some(partition.app, partition.country, None, 0, self.pages):
            yield partition.app, partition.country, page, body, error


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The round to go to: the next one if the last one is complete and has more, else the last."""
        n = self.ledger.last()
        if not n:
            return {"round": min(1, len(self.feeds))}
        names = self.ledger.names(n)
        asked = sum(x == "more" for x in self.ledger.names(n - 1).values()) if n > 1 else len(set(self.feeds))
        return {"round": n + (len(names) >= asked and "more" in names.values())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["round"] > start["round"] + 1:
            raise ValueError("rounds go one by one")
        n = start["round"]
        feeds = [Feed(*f, n) for f in dict.fromkeys(self.feeds)] if end["round"] > n else []
        if n:
            there = self.ledger.names(n)
            feeds = [f for f in feeds if there.get(f.name) == "more"]
        return feeds

    def read(self, partition: Feed) -> Iterator[tuple]:
        entry = self.ledger.read(partition.after, partition.name)
        token, done, failed = entry["token"], entry["page"], entry["failed"]
        more = True
        for page, body, error, following in self.some(partition.app, partition.country, token, done, self.batch_pages):
            token = following
            if error is None:
                done, failed, more = page + 1, 0, following is not None
            else:
                failed += 1
                more = failed < self.rounds
            if error is None or not more:
                yield partition.app, partition.country, page, body, error
        self.ledger.put(partition.after + 1, partition.name, {"token": token, "page": done, "failed": failed}, more and done < self.pages)

    def commit(self, end: dict) -> None:
        pass


class Stored:
    """A fetcher of pages that a crawl has saved: a line for each page, in order, in one file of ``app=.../country=...`` under a
    folder that all executors share. A page's token is where its line begins, so each page is read once, by itself."""

    STEP = 1 << 16

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def __call__(self, app: str, country: str, token: str | None) -> tuple[str, str | None]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.uri)
        found = files.get_file_info(fs.FileSelector(f"{root}/app={app}/country={country}"))
        (saved,) = (f.path for f in found if f.base_name.startswith("part-"))
        with files.open_input_file(saved) as f:
            size, at = f.size(), int(token or 0)
            f.seek(at)
            read: list[bytes] = []
            while not read or (read[-1] and b"\n" not in read[-1]):
                read.append(f.read(self.STEP))
            body = b"".join(read).split(b"\n", 1)[0]
            end = at + len(body) + 1
        return body.decode(), str(end) if end < size else None


def paged_source(fetch: Fetch, name: str = "paged") -> type[DataSource]:
    """The data source of a fetcher. Options: feeds (JSON list of [app, country]), pages (limit for each feed), attempts, pause;
    for streams ledger (a folder's URI), batch_pages, rounds."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return _Reader(fetch, self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
            return _StreamReader(fetch, self.options)

    return Paged


def pages(spark: SparkSession, fetch: Fetch, feeds: list[tuple[str, str]], stream: bool = False, name: str = "paged", **options: object):  # noqa: ANN201
    """The pages of some feeds as a frame, or as a stream."""
    spark.dataSource.register(paged_source(fetch, name))
    reader = spark.readStream if stream else spark.read
    return reader.format(name).options(feeds=json.dumps(feeds), **{k: str(v) for k, v in options.items()}).load()


def drained(query: StreamingQuery) -> None:
    """Run a query of such a stream until all feeds are done, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
