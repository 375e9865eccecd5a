"""``python -m tidewater [--slt FILE]``: runs SQL from standard input, or a logic test."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tidewater import slt
from tidewater.plans.tokens import statements, tokenize
from tidewater.session import connect


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("tidewater").getOrCreate()
    session = connect(spark)
    if args[:1] == ["--slt"]:
        print(f"{slt.run(session, Path(args[1]).read_text())} records passed")
        return 0
    for tokens in statements(tokenize(sys.stdin.read())):
        result = session.run(tokens)
        if result.frame is not None:
            result.frame.show(truncate=False)
        else:
            print(f"{result.kind}: {result.rows} rows")
    session.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
