"""python -m umbral.cli scan|mask|inspect|pack|unpack|profile PATH ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="umbral")
    p.add_argument("command", choices=["scan", "mask", "inspect", "pack", "unpack", "profile"])
    p.add_argument("path")
    p.add_argument("--output")
    p.add_argument("--salt")
    p.add_argument("--key")
    a = p.parse_args(argv)
    from .functions.detect import scan
    from .operators.mask import mask
    from .sources import files, sealed

    spark = SparkSession.builder.getOrCreate()
    if a.command == "scan":
        print(json.dumps({c: r.to_dict() for c, r in scan(files.read_file(spark, a.path)).items()}, indent=2))
    elif a.command == "profile":
        print(json.dumps(files.profile(spark, a.path), indent=2, default=str))
    elif a.command == "mask":
        files.write(mask(files.read_file(spark, a.path), salt=a.salt), a.output, mode="overwrite")
    elif a.command == "pack":
        sealed.write(files.read_file(spark, a.path), a.output, a.key, overwrite=True)
    elif a.command == "unpack":
        files.write(sealed.read(spark, a.path, a.key), a.output, mode="overwrite")
    else:
        print(json.dumps({k: v for k, v in sealed.inspect(spark, a.path, a.key).items() if k != "schema"}, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
