"""Times the search shapes on stored tables: the tables are built once (timed apart), then each search runs once to warm up and three times for
its median. One JSON line."""

import json
import os
import tempfile
import time
from dataclasses import replace
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldlog.operators import star
from fieldlog.operators.search import Search
from fieldlog.plans import roles
from fieldlog.plans.checks import log


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="fieldlog-bench-")
    # Few cores and small tables: as many partitions as cores when building.
    build_s = timed(lambda: star.build(log(spark, folder), root))
    for name, sql in (("games_of_log", roles.GAMES), ("entries", roles.ENTRIES)):
        roles.view(spark, folder, sql).write.parquet(f"{root}/{name}")
    t = replace(star.stored(spark, root), games=spark.read.parquet(f"{root}/games_of_log"), entries=spark.read.parquet(f"{root}/entries"))

    motivating = lambda: Search().strikeout().bases_loaded().outs(2).force_play("2").putout_sequence("26")

    def with_reports() -> None:
        s = motivating()
        for frame in (s.run_rows(t), s.excluded(t), s.coverage(t), s.force_report(t)):
            frame.collect()

    count = lambda s: lambda: s().count(t).collect()
    rows = lambda s: lambda: s().run_rows(t).write.format("noop").mode("overwrite").save()
    shapes = {
        "motivating_count": count(motivating),
        "motivating_reports": with_reports,
        "common_tag_count": count(lambda: Search().tag("Strikeout")),
        "rare_tag_count": count(lambda: Search().tag("InfieldFly")),
        "rare_tag_rows": rows(lambda: Search().tag("InfieldFly")),
        "tag_season": count(lambda: Search().tag("Single").season(2001)),
        "two_tags": count(lambda: Search().tag("Strikeout").tag("BasesLoaded")),
        "force_predicate": count(lambda: Search().force_play("2")),
        "putout_sequence": count(lambda: Search().putout_sequence("63")),
        "contains_sequence": count(lambda: Search().contains_sequence("6")),
        "context_only": count(lambda: Search().runner_on(3).outs(2)),
        "pitcher_interval": count(lambda: Search().pitcher("P1")),
        "hit_location": count(lambda: Search().hit_location("8")),
        "hit_location_prefix": count(lambda: Search().hit_location("8*")),
        "any_of": count(lambda: Search().any_of(Search().tag("Single").outs(0), Search().out_at("2"))),
    }
    found = {"K1_build": round(build_s, 4)}
    for name, run in shapes.items():
        run()
        found[name] = round(median(timed(run) for _ in range(3)), 4)
    plays = spark.read.parquet(f"{root}/plays").agg(F.count(F.lit(1))).first()[0]
    searches = sum(v for k, v in found.items() if k != "K1_build")
    print(json.dumps({"metric": "searches on stored tables, sum of medians", "value": round(searches, 4), "unit": "sec", "queries": found, "plays": plays, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
