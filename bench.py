"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line of seconds, the median of three runs, and
the rates of planning and emitting all samples: of the documents, and of lineitem as a long-tailed source."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = ("padding_ratio", "padding_compare", "greedy_groups", "greedy_groups_patches", "single_rank_plan", "align_sizes", "tokens_exact", "tokens_approx", "group_order_flip", "recycle_plan", "coverage_audit", "sample_progress", "lr_ticks", "scale_loss", "pad_collate")


def timed(run, times: int = 3) -> float:
    out = []
    for _ in range(times):
        t = time.time()
        run()
        out.append(time.time() - t)
    return statistics.median(out)


def sink(d: DataFrame) -> None:
    d.write.format("noop").mode("overwrite").save()


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as samples of four ranks: lengths from a hash, 64 to 4,095, mostly short."""
    from paceline.sources import samples as S

    u = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1 << 20)) / float(1 << 20)
    length = (64 + 4032 * u * u * u).cast("long")
    key = F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")
    return S.samples(S.table(spark, sf, "lineitem").select(key.alias("k"), length.alias("n")), "k", F.col("n"), 4)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from paceline.config import PlanConfig
    from paceline.operators import planner, segment, windows
    from paceline.plans.queries import QUERIES
    from paceline.sources.samples import document_samples

    out = {name: round(timed(lambda name=name: sink(QUERIES[name](spark, sf))), 3) for name in HEADLINE}
    rates = {}
    for name, samples in (("documents", lambda: document_samples(spark, sf, 4)), ("lineitem", lambda: lines(spark, sf))):
        n, tokens = samples().agg(F.count(F.lit(1)), F.sum("length")).first()
        ways = {
            "rounds": lambda s: sink(segment.group_table(segment.greedy_groups(windows.windows(s, 128), 16_384))),
            "plan": lambda s: sink(planner.plan(s, PlanConfig(16_384, 128, 4))),
        }
        for way, run in ways.items():
            seconds = timed(lambda run=run, samples=samples: run(samples()))
            out[f"{way}_{name}"] = round(seconds, 3)
            rates[f"{way}_{name}"] = {"samples_per_s": round(n / seconds), "real_tokens_per_s": round(tokens / seconds)}
    total = round(sum(out[q] for q in HEADLINE), 3)
    print(json.dumps({"metric": "planner_queries_total", "value": total, "unit": "sec", "queries": out, "rates": rates, "sf": sf}))


if __name__ == "__main__":
    main()
