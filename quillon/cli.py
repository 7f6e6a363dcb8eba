"""Command line: index, find, related, status, config."""

import argparse
import json
import sys
from pathlib import Path

from . import config as settings
from .session import ship_package


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("--config", default=str(Path.home() / ".config/quillon/config.toml"))
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("path")
    index.add_argument("--reindex", action="store_true")
    index.add_argument("--no-semantic", action="store_true")
    for name, argument in (("find", "query"), ("related", "file")):
        one = sub.add_parser(name)
        one.add_argument(argument)
        one.add_argument("--path", default=".")
        one.add_argument("--max-results", type=int)
    sub.add_parser("status").add_argument("--path", default=".")
    conf = sub.add_parser("config")
    conf.add_argument("action", choices=("set", "list", "add-ignore", "remove-ignore", "list-ignore", "path"))
    conf.add_argument("values", nargs="*")
    return p


def configure(a, config) -> str:
    if a.action == "path":
        return a.config
    if a.action == "list":
        return json.dumps(settings.to_dict(config), indent=1)
    if a.action == "list-ignore":
        return "\n".join(config.excluded)
    if a.action == "set":
        config = settings.assigned(config, *a.values)
    elif a.action == "add-ignore":
        config = settings.ignoring(config, *a.values)
    else:
        config = settings.not_ignoring(config, a.values[0])
    settings.save(config, a.config)
    return "saved"


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    config = settings.load(a.config)
    if a.command == "config":
        print(configure(a, config))
        return
    from pyspark.sql import SparkSession

    from .plans.engine import Engine

    spark = SparkSession.builder.appName("quillon").getOrCreate()
    ship_package(spark)
    engine = Engine(spark, str(Path(a.path).resolve()) if "://" not in a.path else a.path, config)
    if a.command == "index":
        print(json.dumps(engine.index(reindex=a.reindex, semantic=not a.no_semantic)))
    elif a.command == "status":
        print(json.dumps(engine.status(), default=str))
    else:
        if a.command == "find" and not engine.status()["semantic"]:
            print("warning: no semantic index here, so results come from keywords alone", file=sys.stderr)
        found = engine.search(a.query, max_results=a.max_results) if a.command == "find" else engine.find_related(a.file, max_results=a.max_results or 10)
        for row in found.toJSON().collect():  # at most max_results rows
            print(row)


if __name__ == "__main__":
    main()
