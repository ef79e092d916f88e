"""python -m ossicle list | catalog | run CONFIG.yaml OUT | query NAME SF_DIR"""

from __future__ import annotations

import pathlib
import sys


def main(args: list[str]) -> int:
    if not args or args[0] not in ("list", "catalog", "run", "query"):
        print(__doc__)
        return 2
    from .functions import registry

    if args[0] == "list":
        folder = pathlib.Path(args[1] if len(args) > 1 else ".")
        print("\n".join(p.stem for p in sorted(folder.glob("*.yaml"))))
        return 0
    if args[0] == "catalog":
        for key, t in sorted(registry.load().items()):
            print(f"{t.family} {key} {t.defaults} {t.description}")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if args[0] == "query":
        from .queries import QUERIES

        QUERIES[args[1]](spark, args[2]).show(50, False)
        return 0
    import yaml

    from .plans.benchmark import run_config
    from .sources.corpora import synthetic

    run_config(spark, yaml.safe_load(pathlib.Path(args[1]).read_text()), synthetic(spark)).write.mode("overwrite").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
