"""Command line: python -m varispark fit|scan JOB.json

A job names the table (Parquet), the formulas and options, and the folder for results:
    {"table": "trial.parquet", "fixed": "y ~ trt", "random": "~ gid", "residual": null, "options": {}, "out": "folder"}
scan also takes "markers" (Parquet with snp and dose), "families" ({"dir": "gid"}) and "tests" (["dir"]).
"""

from __future__ import annotations

import json
import sys


def main(argv: list[str]) -> int:
    if len(argv) != 2 or argv[0] not in ("fit", "scan"):
        print(__doc__, file=sys.stderr)
        return 2
    with open(argv[1]) as text:
        job = json.load(text)
    from pyspark.sql import SparkSession

    from varispark.operators import genome, reml, tables
    from varispark.sources import bundle

    spark = SparkSession.builder.getOrCreate()
    result = reml.reml(spark.read.parquet(job["table"]), job["fixed"], job.get("random"), job.get("residual"), **job.get("options", {}))
    print(tables.report(result))
    if argv[0] == "fit":
        bundle.save_model(spark, result.model, f"{job['out']}/model")
        bundle.save_result(result, f"{job['out']}/result")
    else:
        found = genome.scan_tests(result, spark.read.parquet(job["markers"]), job["families"], job["tests"], **job.get("scan_options", {}))
        genome.write_scan(found, job["out"], job["tests"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
