"""Command lines from the arguments or from standard input: python -m keyloom.cli STORE_DIR [COMMAND ...]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from keyloom.plans.store import Store


def main(argv: list[str]) -> int:
    """Print a reply for each line; 1 if any is an error."""
    if not argv:
        print(__doc__, file=sys.stderr)
        return 2
    lines = [" ".join('"' + a.replace("\\", "\\\\").replace('"', '\\"') + '"' if i and (" " in a or not a) else a for i, a in enumerate(argv[1:]))] if len(argv) > 1 else [x.rstrip("\n") for x in sys.stdin]
    spark = SparkSession.builder.appName("keyloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    failed = False
    for r in Store(spark, argv[0]).execute(lines).orderBy("seq").toLocalIterator():
        print(r.reply)
        failed |= r.reply.startswith("(error)")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
