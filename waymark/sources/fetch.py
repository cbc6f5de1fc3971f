"""Bounded fetches over HTTP: files, members of archives, query results, and answers of other geocoders.

They run on the driver, a request at a time, and hand files or rows to Spark.  Nothing larger than the stated bounds is
ever held or written, whatever a server sends.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

AGENT = "waymark/1"
CHUNK = 1 << 20


class TooLarge(ValueError):
    """More bytes than were allowed."""


def fetch(url: str, target: str | None = None, max_bytes: int = 1 << 30, timeout: float = 60, headers: dict[str, str] | None = None, data: bytes | None = None) -> bytes | str:
    """The body of ``url``, or with ``target`` its path after it was written there whole."""
    request = urllib.request.Request(url, data=data, headers={"User-Agent": AGENT, **(headers or {})})
    staged = f"{target}.part" if target else None
    out = open(staged, "wb") if staged else io.BytesIO()  # noqa: SIM115
    try:
        with out, urllib.request.urlopen(request, timeout=timeout) as answer:
            said = answer.headers.get("Content-Length")
            if said and int(said) > max_bytes:
                raise TooLarge(f"{url} announces {said} bytes")
            held = 0
            while part := answer.read(CHUNK):
                held += len(part)
                if held > max_bytes:
                    raise TooLarge(f"{url} sends more than {max_bytes} bytes")
                out.write(part)
            if said and held != int(said):
                raise OSError(f"{url} sent {held} of {said} bytes")
            if not target:
                return out.getvalue()
    except BaseException:
        if staged and os.path.exists(staged):
            os.remove(staged)
        raise
    os.replace(staged, target)
    return target


def unzip_one(archive: str, target: str, ending: str = ".csv", max_bytes: int = 32 << 30, max_ratio: int = 100) -> str:
    """The one member of ``archive`` whose name ends so, written to ``target`` under bounds of size and ratio."""
    with zipfile.ZipFile(archive) as z:
        found = [m for m in z.infolist() if not m.is_dir() and m.filename.endswith(ending)]
        if len(found) != 1:
            raise ValueError(f"{archive} has {len(found)} members *{ending}, not one")
        most, held = min(max_bytes, max(1, found[0].compress_size) * max_ratio), 0
        staged = f"{target}.part"
        try:
            with z.open(found[0]) as source, open(staged, "wb") as out:
                while part := source.read(CHUNK):
                    held += len(part)
                    if held > most:
                        raise TooLarge(f"{found[0].filename} unpacks to more than {most} bytes")
                    out.write(part)
        except BaseException:
            if os.path.exists(staged):
                os.remove(staged)
            raise
    os.replace(staged, target)
    return target


def retried(call: Callable, tries: int = 4, first_wait: float = 1.0, sleep: Callable = time.sleep):
    """``call()`` until it succeeds; refusals other than 'too many' and server faults are final."""
    for turn in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if turn == tries - 1 or (e.code < 500 and e.code != 429):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if turn == tries - 1:
                raise
        sleep(first_wait * 2**turn)
    raise ValueError("no tries were allowed")


def sparql(spark: SparkSession, endpoint: str, query: str, columns: list[str], max_bytes: int = 64 << 20, **retry) -> DataFrame:
    """The bindings of a query as text columns, null where one is unbound."""
    body = urllib.parse.urlencode({"query": query, "format": "json"}).encode()
    got = json.loads(retried(lambda: fetch(endpoint, max_bytes=max_bytes, headers={"Accept": "application/sparql-results+json"}, data=body), **retry))
    rows = [tuple(b.get(c, {}).get("value") for c in columns) for b in got["results"]["bindings"]]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


class CachedAnswers:
    """Answers of another geocoder's HTTP service: one request a ``wait``, each answer kept as a file by its request's digest."""

    def __init__(self, folder: str, endpoint: str, wait: float = 1.0, max_bytes: int = 1 << 20, sleep: Callable = time.sleep, clock: Callable = time.monotonic):
        self.folder, self.endpoint, self.wait, self.max_bytes, self.sleep, self.clock = Path(folder), endpoint, wait, max_bytes, sleep, clock
        self.folder.mkdir(parents=True, exist_ok=True)
        self.last: float | None = None

    def ask(self, **parameters: str) -> dict:
        url = f"{self.endpoint}?{urllib.parse.urlencode(sorted(parameters.items()))}"
        kept = self.folder / f"{hashlib.sha256(url.encode()).hexdigest()}.json"
        if not kept.exists():
            if self.last is not None and (left := self.last + self.wait - self.clock()) > 0:
                self.sleep(left)
            body = retried(lambda: fetch(url, max_bytes=self.max_bytes), sleep=self.sleep)
            self.last = self.clock()
            staged = kept.with_suffix(".part")
            staged.write_text(json.dumps({"request": parameters, "answer": json.loads(body)}))
            staged.replace(kept)
        return json.loads(kept.read_text())["answer"]

    def table(self, spark: SparkSession) -> DataFrame:
        """Everything that is kept: request and answer as JSON text."""
        return spark.read.schema("request string, answer string").json(f"{self.folder}/*.json")
