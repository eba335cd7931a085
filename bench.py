"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from quadrille import catalog
from quadrille.session import local_session, ship

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ["cell_counts_grid", "tree_capacity_2d", "local_knn_bf", "local_knn_ps", "range_join", "knn_join_grid_2d", "knn_join_tree_2d", "knn_join_sweep", "knn_skewed_tree"]


def main() -> None:
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    ship(spark)
    took = {}
    for name in NAMES:
        began = time.time()
        catalog.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
