"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seekloom.functions import text as t
from seekloom.operators import grams, metadata, search
from seekloom import suite

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Blocks of the index; small, as the tables are.
BLOCK = 1 << 16
OUT = os.environ.get("BENCH_TMP", "/tmp/seekloom-bench")
HEADLINE = ["unit_lines", "literal_hits_ci", "regex_units", "first_batch", "metadata_and", "session_and", "gram_df", "overlay_current", "overlay_content_search", "reconcile_actions", "journal_normalise", "tree_paths"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, f, repeats: int = 1) -> None:
        best = None
        for _ in range(repeats):
            start = time.perf_counter()
            f()
            best = min(best or 1e9, time.perf_counter() - start)
        seconds[name] = round(best, 4)

    run = lambda df: df.write.format("noop").mode("overwrite").save()
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        timed(name, lambda name=name: run(suite.QUERIES[name](spark, SF)))

    # A store once written serves warm searches: stored units and the index are read, not made anew.
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    source = docs.agg(F.sum(F.octet_length("text"))).head()[0]
    timed("ingest_units", lambda: grams.packed(t.normalised_units(docs), BLOCK).write.mode("overwrite").parquet(f"{OUT}/units"))
    units = spark.read.parquet(f"{OUT}/units")

    def ingest() -> None:
        for name, df in grams.Index.build(units, source).items():
            df.write.mode("overwrite").parquet(f"{OUT}/{name}")

    timed("ingest_grams", ingest)
    index = grams.Index(spark.read.parquet(f"{OUT}/postings"), spark.read.parquet(f"{OUT}/present"))
    records = metadata.searchable(metadata.of_documents(spark.read.parquet(f"{SF}/documents.parquet")))
    records.write.mode("overwrite").parquet(f"{OUT}/records")
    records = spark.read.parquet(f"{OUT}/records")
    # a literal that one block has: eight letters around the rarest gram
    rare = index.present.where("df = 1").join(index.postings, "gram").orderBy("gram").head()["gram"]
    raw = (rare & 0xFFFFFF).to_bytes(3, "big")
    held = units.where(F.contains(F.encode("folded", "UTF-8"), F.lit(raw))).select("folded").head()["folded"]
    at = len(held.encode()[: held.encode().find(raw)].decode(errors="ignore"))
    literal = held[max(0, at - 3) : at + 5]
    timed("warm_literal_scan", lambda: run(search.literal_hits(units, "worthless")), 3)
    timed("warm_rare_scan", lambda: run(search.literal_hits(units, literal)), 3)
    timed("warm_literal_pruned", lambda: run(search.literal_hits(index.pruned(units, literal), literal)), 3)
    timed("warm_zero_hit", lambda: run(search.literal_hits(index.pruned(units, "QZXJ-never"), "QZXJ-never")), 3)
    timed("warm_regex", lambda: run(search.regex_hits(units, r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com")), 3)
    timed("warm_metadata_name", lambda: run(records.where(metadata.predicate(filename="doc_77")).limit(100)), 3)
    stored = sum(os.path.getsize(os.path.join(folder, f)) for name in ("postings", "present") for folder, _, files in os.walk(f"{OUT}/{name}") for f in files if f.endswith(".parquet"))
    extra = {
        "source_mb": round(source / 1e6, 3),
        "ingest_mb_per_s": round(source / 1e6 / (seconds["ingest_units"] + seconds["ingest_grams"]), 2),
        "index_share": round(stored / source, 4),
        "scan_mb_per_s": round(source / 1e6 / seconds["warm_literal_scan"], 2),
        "units": units.count(),
        "units_after_pruning": index.pruned(units, literal).count(),
        "cpus": int(CPUS),
    }
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF, **extra}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
