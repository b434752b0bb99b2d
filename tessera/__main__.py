"""python -m tessera profile FILE... | layout COPYBOOK"""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import SparkSession

from tessera import api


def main() -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("what", choices=["profile", "layout"])
    parser.add_argument("files", nargs="+")
    parser.add_argument("--strict", action="store_true", help="sizes as compilers have them")
    parser.add_argument("--free", action="store_true", help="the copybook has no columns to cut")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.what == "layout":
        for path in args.files:
            for schema in api.schemas_from_copybook(api.read_copybook(spark, path), args.strict, free=args.free):
                print(api.Layout(schema, strict=args.strict).explain())
    else:
        frames = [api.read_any(spark, path) for path in args.files]
        print(api.profile_report(api.profile(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))))


if __name__ == "__main__":
    main()
