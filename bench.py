"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import time

from voltweave.plans import catalogue
from voltweave.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "tile_assign_count", "tile_rook_components", "sjoin_point_in_box", "sjoin_box_box_intersects", "semi_touch_flag", "nearest_site", "nearest_line", "knn3_sites", "radius_count_1km",
    "box_overlap_area_sum", "seg_box_clip_length_pivot", "line_union_overlap_frac", "cut_by_exclusions", "distance_dedup", "dbscan_clusters", "building_clusters", "building_stats_buffer",
    "parcel_weighted_mean", "per_name_stats", "parallel_edge_dedupe", "node_adjacency", "stub_removal", "planarise_pieces", "prune_network", "nearest_targets",
    "zonal_class_pct", "disc_fraction", "box_mean_tpi", "gradient_slope", "raster_regions", "clip_log_robust_scale", "roc_auc_exact", "avg_precision", "spatial_folds",
]


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    queries["tile_assign_count"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiles, reads footers
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
