"""environs {ingest,score,validate,report,webdata,diff} --root FOLDER [--city all|a,b] [--release latest|ID] [--against ID] [--cities|--weights|--taxonomy|--institutions|--brands FILE]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import config
from .pipeline import Engine
from .session import ship
from .sources import readers

COMMANDS = ["ingest", "score", "validate", "report", "webdata"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="environs", description=__doc__)
    p.add_argument("command", choices=[*COMMANDS, "diff", "all"])
    p.add_argument("--root", required=True)
    p.add_argument("--city", default="all")
    p.add_argument("--release", default="latest")
    for name in ("cities", "weights", "taxonomy", "institutions", "brands"):
        p.add_argument(f"--{name}", metavar="FILE", help=f"{name} from a file, in place of those built in")
    p.add_argument("--against", help="the older release that diff compares with")
    return p


def folders(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "diff" and not a.against:
        p.error("diff needs --against")
    spark = spark or SparkSession.builder.appName("environs").getOrCreate()
    ship(spark)
    release = readers.local_release(folders(spark, f"{a.root}/etl") + folders(spark, f"{a.root}/release"), a.release)
    values = [f(p) for f, p in ((config.weights_file, a.weights), (config.taxonomy_file, a.taxonomy)) if p]
    with config.using(*values):
        engine = Engine.open(spark, a.root, release, a.city, city_file=a.cities, institutions=a.institutions, brands=a.brands, more=(a.weights, a.taxonomy))
        for c in COMMANDS if a.command == "all" else [a.command]:
            out = engine.diff(a.against) if c == "diff" else getattr(engine, c)()
            print(f"{c}: {out if isinstance(out, (dict, int)) else 'done'}")


if __name__ == "__main__":
    main()
