"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pairforge.plans import catalog
from pairforge.session import get_session

HEADLINE = (
    "kmeans_center_stats", "kmeans_two_iterations", "pairs_all_mirrored", "pairs_membership_pass", "density_matrix", "vda_memberships",
    "compare_best_overlap", "reduce_vectors", "reduce_correlation", "smith_waterman", "needleman_wunsch", "rotation_fit",
    "transform_bin_weights", "centers_all_methods", "da_m_step", "mds_gradient", "mds_hessian_product", "kmeans_bounded", "mds_center",
    "vda_em_update", "vda_bounded_memberships", "lcms_sponge_again", "file_matrix_slices", "function_statistics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session(os.environ.get("BENCH_CPUS", "8"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["reduce_sums"](spark, sf_dir).collect()  # the session's first query pays for its start
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
