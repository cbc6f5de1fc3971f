"""Spark data sources for OpenStreetMap extracts: elements with kind, id, tags, refs, lat and lon.

``spark.dataSource.register(OsmDataSource)`` makes ``spark.read.format("osm_xml").load(path)`` work, and
``OsmPbfDataSource`` the binary format under the name ``osm_pbf``.  A path names a file or a folder that all executors
can open.  An XML file is one partition.  A binary file is a row of independent blobs: the driver only skips from one
blob's head to the next, and so many blobs are one partition.
"""

from __future__ import annotations

import glob
import os
import struct
import xml.etree.ElementTree as ET
import zlib
from itertools import accumulate

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, tags map<string,string>, refs array<long>, lat double, lon double"
#: Blobs that one partition decodes; a blob holds some thousand elements.
BLOBS = 16
#: Fixed values of the format: the largest head and the largest blob.
MOST_HEAD, MOST_BLOB = 64 * 1024, 32 * 1024 * 1024


def _files(path: str, ending: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, f"*{ending}"))) if os.path.isdir(path) else [path]


class _Part(InputPartition):
    def __init__(self, path: str, blobs: list[tuple[int, int]] | None = None):
        self.path, self.blobs = path, blobs


class _XmlReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Part(f) for f in _files(self.path, ".osm")]

    def read(self, partition):
        for _, e in ET.iterparse(partition.path, events=("end",)):
            if e.tag not in ("node", "way", "relation"):
                continue
            tags = {t.get("k"): t.get("v") for t in e.findall("tag")}
            refs = [int(x.get("ref")) for x in [*e.findall("nd"), *e.findall("member")]] or None
            lat, lon = (float(e.get(c)) if e.get(c) else None for c in ("lat", "lon"))
            yield e.tag, int(e.get("id")), tags, refs, lat, lon
            e.clear()


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of a message: whole numbers, or the bytes of strings, packed lists and messages."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("a field ends behind its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown kind of field {kind}")
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def _long(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def blobs_of(path: str) -> list[tuple[int, int]]:
    """Place and size of every data blob of a file, from the heads alone."""
    out = []
    with open(path, "rb") as f:
        end = os.fstat(f.fileno()).st_size
        while (head := f.read(4)) != b"":
            size = struct.unpack(">I", head)[0] if len(head) == 4 else MOST_HEAD + 1
            if size > MOST_HEAD:
                raise ValueError(f"{path} is no extract: a head of {size} bytes")
            own = dict(fields(f.read(size)))
            at = f.tell()
            if own.get(3, MOST_BLOB + 1) > MOST_BLOB or at + own[3] > end:
                raise ValueError(f"{path} is cut off, or holds a blob that is too large")
            if own.get(1) == b"OSMData":
                out.append((at, own[3]))
            f.seek(own[3], 1)
    return out


def unpacked(blob: bytes) -> bytes:
    """What a blob holds; it may not unpack to more than it says, nor to more than the format allows."""
    own = dict(fields(blob))
    if 1 in own:
        return own[1]
    if 3 not in own:
        raise ValueError("only plain and zlib blobs can be read")
    size = own.get(2, MOST_BLOB)
    if size > MOST_BLOB:
        raise ValueError("a blob is too large")
    d = zlib.decompressobj()
    out = d.decompress(own[3], size)
    if d.unconsumed_tail or (2 in own and len(out) != size):
        raise ValueError("a blob does not have the size that it states")
    return out


def elements(block: bytes):
    """Rows of SCHEMA from one block."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 19:
            lat0 = _long(v)
        elif n == 20:
            lon0 = _long(v)
    deg = lambda base, v: (base + grain * v) / 1e9
    for group in groups:
        for kind, message in fields(group):
            if kind == 2:
                yield from _dense(message, strings, lambda v: deg(lat0, v), lambda v: deg(lon0, v))
            elif kind in (1, 3, 4):
                own: dict = {}
                for n, v in fields(message):
                    own[n] = own[n] + v if isinstance(v, bytes) and n in own else v
                tags = {strings[k]: strings[v] for k, v in zip(packed(own.get(2, b"")), packed(own.get(3, b"")), strict=True)}
                if kind == 1:
                    yield "node", _zigzag(own[1]), tags, None, deg(lat0, _zigzag(own[8])), deg(lon0, _zigzag(own[9]))
                else:
                    refs = list(accumulate(packed(own.get(8 if kind == 3 else 9, b""), True))) or None
                    yield "way" if kind == 3 else "relation", _long(own[1]), tags, refs, None, None


def _dense(message: bytes, strings: list[str], lat, lon):
    own: dict = {}
    for n, v in fields(message):
        own[n] = own[n] + v if isinstance(v, bytes) and n in own else v
    columns = [accumulate(packed(own.get(n, b""), True)) for n in (1, 8, 9)]
    words = iter(packed(own.get(10, b"")))
    for i, y, x in zip(*columns, strict=True):
        tags = {}
        while k := next(words, 0):
            tags[strings[k]] = strings[next(words)]
        yield "node", i, tags, None, lat(y), lon(x)


class _PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out = []
        for f in _files(self.path, ".pbf"):
            blobs = blobs_of(f)
            out += [_Part(f, blobs[i : i + BLOBS]) for i in range(0, len(blobs), BLOBS)]
        return out

    def read(self, partition):
        if partition is None or not partition.blobs:
            return
        with open(partition.path, "rb") as f:
            for at, size in partition.blobs:
                f.seek(at)
                yield from elements(unpacked(f.read(size)))


class OsmDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_xml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _XmlReader(self.options["path"])


class OsmPbfDataSource(OsmDataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def reader(self, schema):
        return _PbfReader(self.options["path"])
