"""Commands for batch jobs: spark-submit -m or python -m lodestone COMMAND STORE [ROOT] [options].

build, code (the code stage alone), check (the code stage if sources have changed), doctor, search QUERY, vacuum. The exit
code is 0 if the build succeeded or the index is healthy."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import Engine
from .operators.store import Store
from .plans import build


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("command", choices=("build", "code", "check", "doctor", "search", "vacuum"))
    parser.add_argument("store")
    parser.add_argument("root", nargs="?", default="")
    parser.add_argument("--query", default="")
    parser.add_argument("--full", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    store = Store(spark, given.store)
    if given.command in ("build", "code"):
        only = (build.CODE,) if given.command == "code" else ()
        result = build.build(spark, given.root, store, only=only, full=given.full)
        print(result)
        return int(not result.ok)
    if given.command == "check":
        result = build.check_sources(spark, given.root, store)
        print(result or "nothing to do")
        return int(result is not None and not result.ok)
    if given.command == "vacuum":
        print(store.vacuum(), "folders removed")
        return 0
    engine = Engine.open(store)
    answer = engine.doctor() if given.command == "doctor" else engine.search(given.query)
    print(engine.envelope(answer))
    return int(given.command == "doctor" and not answer.where("check = 'healthy'").first()["ok"])


if __name__ == "__main__":
    sys.exit(main())
