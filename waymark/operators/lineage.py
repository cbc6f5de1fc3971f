"""Where truth rows come from: do their sources share an origin with what is being judged?"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lineage(sources: Column, direct: Column, upstream: list[str], independent: list[str]) -> Column:
    """common_upstream if any source is upstream; outside_chain if all are independent and the geometry is direct; else unknown_lineage."""
    shared = F.exists(sources, lambda s: s.isin(upstream))
    apart = F.forall(sources, lambda s: s.isin(independent)) & (F.size(sources) > 0) & F.coalesce(direct, F.lit(False))
    return F.when(shared, "common_upstream").when(apart, "outside_chain").otherwise("unknown_lineage")


def geometry_sources(records: Column) -> Column:
    """Of source records (struct of property and dataset), those of the geometry, else those of the whole row."""
    geometry = F.filter(records, lambda r: r["property"] == "/geometry")
    root = F.filter(records, lambda r: F.coalesce(r["property"], F.lit("")) == "")
    return F.transform(F.when(F.size(geometry) > 0, geometry).otherwise(root), lambda r: r["dataset"])


def contains_tokens(text: Column, part: Column) -> Column:
    """Does the text hold the part as a run of whole words?"""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return pad(text).contains(pad(part))


def host_is(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts), F.lit(False))
