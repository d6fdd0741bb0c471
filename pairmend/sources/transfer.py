"""Bytes that move: fetching from URLs, writing and copying files, each file whole or not at all.

Executors read and write paths of a file system that all machines mount. A file is written beside its
place and renamed into it, so readers see the old one or the new one, and a task that runs twice, or dies half-way and is
tried again, leaves one whole file.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmend.sources.shared import settle

#: Bytes read from an answer at a time, seconds until one is given up, tries, and requests to one host at once.
PIECE, TIMEOUT, TRIES, PER_HOST = 256 * 1024, 30.0, 3, 4

FETCHED = "url string, content binary, tries int, error string"
MOVED = "source string, target string, ok boolean, error string"


def http_get(url: str, timeout: float = TIMEOUT) -> bytes:
    """An answer's bytes, read piece by piece; an answer that ends early is an error."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "pairmend"}), timeout=timeout) as answer:
        pieces = list(iter(lambda: answer.read(PIECE), b""))
        size = answer.headers.get("Content-Length")
    content = b"".join(pieces)
    if size is not None and int(size) != len(content):
        raise OSError(f"{len(content)} of {size} bytes came")
    return content


def fetch_all(urls: DataFrame, fetcher: Callable[[str], bytes] = http_get, url: str = "image_url", per_host: int = PER_HOST, tries: int = TRIES, pause: float = 0.5) -> DataFrame:
    """FETCHED rows, one for each distinct URL: its content, or null and why not after so many tries.

    URLs are dealt by host and slot, so that no host gets more than per_host requests at once, however many tasks
    run and however large a host's share is; tries are parted by pauses that double. Null and empty URLs are left out.
    """
    asked = urls.select(F.trim(F.col(url)).alias("url")).filter("url <> ''").distinct()
    host = F.lower(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1))
    dealt = asked.withColumn("host", host).withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(per_host)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch["url"]:
                content, error, n = None, None, 0
                while content is None and n < tries:
                    if n:
                        time.sleep(pause * 2 ** (n - 1))
                    n += 1
                    try:
                        content, error = fetcher(one), None
                    except Exception as e:  # whatever goes wrong, it is this URL's alone
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"url": [one], "content": [content], "tries": [n], "error": [error]})

    return dealt.repartition("host", "slot").select("url").mapInPandas(run, FETCHED)


def _into_place(target: str, write: Callable[[str], object]) -> None:
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    aside = f"{target}.{uuid.uuid4().hex}.aside"
    try:
        write(aside)
        os.replace(aside, target)
    finally:
        if os.path.exists(aside):
            os.unlink(aside)


def write_files(rows: DataFrame, target: Column, content: Column) -> DataFrame:
    """MOVED rows (source null) of files written where they belong, once a target; rows without content are left out.

    Of rows with one target that of the greatest content is written. Rows that fail say why.
    """
    given = rows.select(target.alias("target"), content.alias("content")).filter("target <> '' and content is not null")
    given = given.groupBy("target").agg(F.max("content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, data in zip(batch["target"], batch["content"], strict=True):
                out.append((None, t, *_done(lambda t=t, data=data: _into_place(t, lambda aside: _dump(aside, data)))))
            yield pd.DataFrame(out, columns=["source", "target", "ok", "error"])

    return settle(given.mapInPandas(run, MOVED))


def _dump(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def _done(act: Callable[[], object]) -> tuple[bool, str | None]:
    try:
        act()
    except OSError as e:
        return False, f"{type(e).__name__}: {e}"
    return True, None


def copy_files(jobs: DataFrame) -> DataFrame:
    """MOVED rows of copies from source to target, all of them from files as they were before the first.

    Sources are first copied beside their targets, all of them; only then are the copies renamed into place. So a target that is another
    job's source is read before it is replaced, and either round may be run again. A target named twice gets its least source.
    Jobs whose source can't be read fail and leave their target as it was.
    """
    jobs = settle(jobs.select("source", "target").filter("source <> '' and target <> ''").groupBy("target").agg(F.min("source").alias("source")))

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, t, *_done(lambda s=s, t=t: _into_place(t + STAGED, lambda aside: shutil.copy2(s, aside)))) for s, t in zip(batch["source"], batch["target"], strict=True)]
            yield pd.DataFrame(out, columns=["source", "target", "ok", "error"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, t, ok, error in zip(batch["source"], batch["target"], batch["ok"], batch["error"], strict=True):
                if ok and os.path.exists(t + STAGED):  # else another try of this task has renamed it
                    ok, error = _done(lambda t=t: os.replace(t + STAGED, t))
                out.append((s, t, ok, error))
            yield pd.DataFrame(out, columns=["source", "target", "ok", "error"])

    staged = settle(jobs.select("source", "target").mapInPandas(stage, MOVED))
    return settle(staged.mapInPandas(place, MOVED))


#: What a copy is called until all are there.
STAGED = ".staged"
