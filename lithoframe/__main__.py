"""put, get, stat, key and fsck on an engine's folder: python -m lithoframe ROOT put FILE... | get ID | stat | key TOKEN... | fsck"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .functions import hashing as H


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    engine, verb, rest = Engine(spark, args[0]), args[1], args[2:]
    if verb == "put":
        rows = [(i, Path(p).read_bytes()) for i, p in enumerate(rest)]
        for r in engine.put_many(spark.createDataFrame(rows, "pos bigint, payload binary")).orderBy("pos").collect():
            print(r.block_id)
    elif verb == "get":
        found = engine.blocks().where(F.col("block_id") == rest[0]).limit(1).collect()
        if not found:
            return 1
        sys.stdout.buffer.write(bytes(found[0].payload))
    elif verb == "key":
        print(spark.range(1).select(H.root_hash(F.array(*[F.lit(int(t)).cast("bigint") for t in rest]))).first()[0])
    elif verb in ("stat", "fsck"):
        for r in (engine.stats() if verb == "stat" else engine.fsck()).toJSON().collect():
            print(r)
    else:
        print(__doc__, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
