"""A small HTTP service over a geocoder: /api, /reverse and /health, with GeoJSON answers.

One session serves one gazetteer, and a request is a table of one query; it is meant for trying things out and for
tools that speak this protocol, not for throughput: batches go to ``Geocoder`` directly.
"""

from __future__ import annotations

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from pyspark.sql import SparkSession

from waymark.sources.jsonl import feature_collection

MOST_BYTES, MOST_ANSWERS = 1024, 100
EMPTY = '{"type":"FeatureCollection","features":[]}'


class Refused(ValueError):
    """A request that can't be answered as it stands."""


def one(found: dict[str, list[str]], name: str) -> str | None:
    values = found.get(name, [])
    if len(values) > 1:
        raise Refused(f"parameter '{name}' occurs more than once")
    return values[0] if values else None


def number(text: str, name: str, most: float) -> float:
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not (math.isfinite(value) and abs(value) <= most):
        raise Refused(f"parameter '{name}' is out of range")
    return value


def parameters(query: str, known: set[str]) -> tuple[dict[str, str | None], int]:
    found = parse_qs(query, keep_blank_values=True)
    if unknown := sorted(set(found) - known - {"limit", "lang"}):
        raise Refused(f"unknown parameters: {unknown}")
    limit = one(found, "limit") or "10"
    if not (limit.isascii() and limit.isdigit() and 1 <= int(limit) <= MOST_ANSWERS):
        raise Refused("parameter 'limit' is out of range")
    return {k: one(found, k) for k in known}, int(limit)


class Service:
    """Requests as (status, JSON text)."""

    def __init__(self, spark: SparkSession, geocoder):
        self.spark, self.geocoder, self.lock = spark, geocoder, threading.Lock()

    def answer(self, path: str, query: str) -> tuple[int, str]:
        try:
            if path == "/health":
                return 200, json.dumps({"status": "ok"})
            if path == "/api":
                return 200, self.forward(query)
            if path == "/reverse":
                return 200, self.backward(query)
        except Refused as e:
            return 400, json.dumps({"message": str(e)})
        return 404, json.dumps({"message": "not found"})

    def forward(self, query: str) -> str:
        p, limit = parameters(query, {"q", "lat", "lon"})
        q = p["q"]
        if not q or not q.strip() or any(ord(c) < 32 or ord(c) == 127 for c in q) or len(q.encode()) > MOST_BYTES:
            raise Refused("parameter 'q' must be text of bounded length")
        if (p["lat"] is None) != (p["lon"] is None):
            raise Refused("parameters 'lat' and 'lon' must occur together")
        if p["lat"] is not None:
            row = (0, q, number(p["lat"], "lat", 90), number(p["lon"], "lon", 180))
            table = self.spark.createDataFrame([row], "query_id long, q string, f_lat double, f_lon double")
            return self.rendered(lambda: self.geocoder.geocode(table, limit, focus=True))
        return self.rendered(lambda: self.geocoder.geocode(self.spark.createDataFrame([(0, q)], "query_id long, q string"), limit))

    def backward(self, query: str) -> str:
        p, limit = parameters(query, {"lat", "lon", "query_string_filter"})
        if p["lat"] is None or p["lon"] is None:
            raise Refused("parameters 'lat' and 'lon' are needed")
        if p["query_string_filter"] not in (None, "osm_key:highway"):
            raise Refused("parameter 'query_string_filter' is unsupported")
        row = (0, number(p["lat"], "lat", 90), number(p["lon"], "lon", 180))
        table = self.spark.createDataFrame([row], "query_id long, lat double, lon double").withColumnRenamed("query_id", "point_id")
        return self.rendered(lambda: self.geocoder.reverse(table, limit).withColumnRenamed("point_id", "query_id"))

    def rendered(self, ask) -> str:
        with self.lock:
            found = feature_collection(ask(), "query_id").first()
        return found["geojson"] if found else EMPTY


def serve(spark: SparkSession, geocoder, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound and not yet running: call its serve_forever()."""
    service = Service(spark, geocoder)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            path, _, query = self.path.partition("?")
            status, body = service.answer(path, query)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
