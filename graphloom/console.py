"""Command line: ``python -m graphloom.console FOLDER`` and then commands."""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Iterable
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from .config import EngineConfig, parse_config, show_config
from .engine import Engine
from .plans.model import QueryError
from .sources.mapping import MappedStore
from .workload import read_mix, run_mix, run_repeated

HELP = """help                                 this list
sparql -f FILE [-p] [-n N] [-v ROWS]     run a query of a file N times; -p: in the plan language; -v: print rows
sparql -s TEXT [-p] [-n N] [-v ROWS]     run a query of the command line
sparql -b FILE [-d S] [-w S]             run a mixed workload for S seconds after a warm-up
show-config | reload-config FILE | run-script FILE | quit"""


class Console:
    def __init__(self, engine: Engine, config: EngineConfig | None = None, out: TextIO = sys.stdout):
        self._engine, self._config, self._out = engine, config or EngineConfig(), out
        self._apply()

    def _apply(self) -> None:
        """Let the settings act on the engine and its session."""
        if self._config.shuffle_partitions:
            self._engine.store.spark.conf.set("spark.sql.shuffle.partitions", self._config.shuffle_partitions)
        if not self._config.use_statistics:
            self._engine.statistics = None
        elif self._engine.statistics is None:
            self._engine.analyze()

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            words = shlex.split(line, comments=True)
            if words[:1] in (["quit"], ["q"]):
                return
            try:
                self._command(words)
            except (QueryError, ValueError, OSError, argparse.ArgumentError) as error:
                self._say(f"error: {error}")

    def _say(self, text: str) -> None:
        print(text, file=self._out)

    def _command(self, words: list[str]) -> None:
        name, arguments = (words[0], words[1:]) if words else ("", [])
        if name == "help":
            self._say(HELP)
        elif name == "show-config":
            self._say(show_config(self._config))
        elif name == "reload-config":
            self._config = parse_config(Path(arguments[0]).read_text(), self._config, reload=True)
            self._apply()
        elif name == "run-script":
            self.run(Path(arguments[0]).read_text().splitlines())
        elif name == "sparql":
            self._sparql(arguments)
        elif name:
            self._say(f"unknown command {name}, try help")

    def _sparql(self, arguments: list[str]) -> None:
        parser = argparse.ArgumentParser("sparql", add_help=False, exit_on_error=False)
        for flag, kind in (("-f", str), ("-s", str), ("-b", str), ("-n", int), ("-v", int), ("-d", float), ("-w", float)):
            parser.add_argument(flag, type=kind)
        parser.add_argument("-p", action="store_true")
        given = parser.parse_args(arguments)
        if given.b:
            mix = Path(given.b)
            log = run_mix(self._engine, read_mix(mix.read_text()), mix.parent, 10.0 if given.d is None else given.d, 5.0 if given.w is None else given.w, self._config.parallel, self._config.heavy_parallel)
            self._say(str(log.summary()))
            return
        text = Path(given.f).read_text() if given.f else given.s
        if not text:
            raise ValueError("sparql needs -f, -s or -b")
        if given.v is not None:
            rows = (self._engine.plan(text) if given.p else self._engine.sparql(text)).limit(given.v or self._config.print_rows)
            for row in rows.collect():
                self._say("\t".join("" if x is None else str(x) for x in row))
        seconds, count = run_repeated(self._engine, text, given.n or 1, given.p)
        self._say(f"{count} rows, {seconds * 1e6:.0f} us on average")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder", help="folder of the tables")
    parser.add_argument("--config", help="file of settings")
    given = parser.parse_args()
    config = parse_config(Path(given.config).read_text()) if given.config else EngineConfig()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    Console(Engine(MappedStore(spark, given.folder)), config).run(sys.stdin)


if __name__ == "__main__":
    main()
