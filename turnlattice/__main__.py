"""python -m turnlattice smoke | preflight DIR | run DIR PATH"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from turnlattice.plans import model_queries, runs


def main(words: list[str]) -> int:
    spark = SparkSession.builder.appName("turnlattice").getOrCreate()
    match words:
        case ["smoke"]:
            row = model_queries.bellman_one_category(spark, "").first()
            print(row)
            return 0 if any(isinstance(v, float) and abs(v - 2.301432126285) < 1e-6 for v in row) else 1
        case ["preflight", folder]:
            found = runs.preflight(spark, folder, {"orders": ["o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_nationkey"]}).collect()
            print(*found, sep="\n")
            return int(not all(r["passed"] for r in found))
        case ["run", folder, path]:
            run = runs.Run(spark, path, runs.order_stages(folder), runs.ORDER_BOUNDS)
            run.run()
            run.status().orderBy("ordinal").show(truncate=False)
            return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
