"""Headline queries on one machine: one JSON line with the seconds of each.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and the cores.  The gazetteer is
built, timed as "build", before queries are asked of it, as a reader of a finished gazetteer would find it.
"""

from __future__ import annotations

import json
import os
import time

from waymark import fixtures, queries as Q
from waymark.operators.gazetteer import streets_of, words_of
from waymark.runtime import local_session

HEADLINE = (
    "structured_geocode", "freeform_plain", "freeform_geocode", "fuzzy_street", "word_subset", "reverse_geocode", "house_interpolate", "street_agg",
    "word_postings", "umbrella_weighted", "point_in_polygon", "score_grouping_sets", "wilson_interval", "hash_topn_per_group", "norm_text",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f):
        t = time.time()
        f()
        took[name] = round(time.time() - t, 3)

    timed("build", lambda: fixtures.gazetteer(spark, sf_dir))
    timed("blocks", lambda: (Q.blocks(spark, sf_dir), Q.cells(spark, sf_dir)))
    gaz = fixtures.gazetteer(spark, sf_dir)
    # these queries only read what "build" wrote: here the aggregation itself is timed
    made = {"street_agg": lambda: streets_of(gaz.houses), "word_postings": lambda: words_of(gaz.streets)}
    for name in HEADLINE:
        make = made.get(name, lambda: Q.QUERIES[name](spark, sf_dir))  # noqa: B023
        timed(name, lambda: make().write.format("noop").mode("overwrite").save())  # noqa: B023
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "seconds for the headline queries", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
