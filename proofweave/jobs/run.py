"""Command line: run a query over a folder of tables and write its result.

    python -m proofweave.jobs.run matrix_status --data DIR --out DIR [--format parquet|csv|json] [--master ...]
"""

from __future__ import annotations

import argparse

from proofweave.plans import registry
from proofweave.session import build_session, ship
from proofweave.sinks import files


def main(argv: list[str] | None = None) -> int:
    """Run one query; 0 if it was written."""
    queries = registry.queries()
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("query", choices=sorted(queries))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    parser.add_argument("--master", default="local[*]")
    args = parser.parse_args(argv)
    spark = build_session(args.master)
    ship(spark)
    result = queries[args.query](spark, args.data)
    if args.format == "csv":
        files.write_csv(result, args.out)
    elif args.format == "json":
        files.write_json(result, args.out)
    else:
        result.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
