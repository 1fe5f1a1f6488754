"""python -m vellumframe analyze FOLDER OUT | validate FOLDER [PREFIX] | layout FILES OUT

Exit code: 0 done, 1 a document failed, 2 wrong use."""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in ("analyze", "validate", "layout"):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from vellumframe.plans import runs

    spark = SparkSession.builder.getOrCreate()
    if argv[0] == "layout":
        for name, df in runs.read_layout(spark, argv[1]).items():
            df.write.mode("overwrite").parquet(f"{argv[2]}/{name}")
        return 0
    dom = runs.read_markup(spark, argv[1])
    if argv[0] == "analyze":
        for name, path in runs.analyze(dom, argv[2]).items():
            print(name, path)
        return 0
    verdicts = runs.check(dom, argv[2] if len(argv) > 2 else "[a-z]+")
    verdicts.show(truncate=False)
    return int(not verdicts.where("status = 'FAILED'").isEmpty())


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
