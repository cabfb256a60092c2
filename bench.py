"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query writes its whole result to the no-op sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from snapline.queries import ALL  # noqa: E402
from snapline.session import local_session  # noqa: E402

HEADLINE = (
    "q01_primary_by_group",
    "q02_recency_natural_join",
    "q03_game_table",
    "q04_rolling",
    "q04_correlations",
    "q05_season_efficiency",
    "q06_success_rate",
    "q07_drive_rollup",
    "q08_last_row_share",
    "q08_quantile_bands",
    "q09_topk_pace",
    "q10_per_game_rates",
    "q11_two_season_pace",
    "q12_year_over_year",
    "q13_full_outer_blend",
    "q14_last6_mean",
    "q15_blend_projection",
    "q16_name_rules",
    "q17_unpivot_extract",
    "q18_slate_draws",
    "q19_qb_linked",
    "q20_showdown_linked",
    "q21_best_lineups",
    "q21_many_lineups",
    "q21_showdown_lineups",
    "q23_mean_scores",
    "q24_exposure",
    "q25_density",
    "q26_grid_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("snapline-bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        ALL[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
