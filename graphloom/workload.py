"""Templates, mixed workloads, and their latency and throughput."""

from __future__ import annotations

import random
import statistics
import time
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace
from itertools import count as count_from
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from .engine import Engine
from .plans.model import Corun, Group, Pattern, Placeholder, Query, QueryError, Step
from .plans.plan_language import parse_plan, placeholders
from .storage import materialize, numbered
from .terms import RDF_TYPE


#: Instances of a type that are kept in memory; of more, the one asked for is looked up in a written table.
KEPT_INSTANCES = 100_000


class Instances:
    """Instances of a type in order of their terms."""

    def __init__(self, engine: Engine, kind: str):
        found = engine.plan(f"SELECT ?x WHERE {{ ?x {RDF_TYPE} {kind} <- }}").select(F.col("x").alias("str"))
        self._table = materialize(numbered(found, 0).sortWithinPartitions("id"), "instances")
        self._count = self._table.count()
        if not self._count:
            raise QueryError(f"no instance of {kind}")
        self._kept = [r["str"] for r in self._table.orderBy("id").collect()] if self._count <= KEPT_INSTANCES else None

    def __len__(self) -> int:
        return self._count

    def __getitem__(self, place: int) -> str:
        return self._kept[place] if self._kept is not None else self._table.where(F.col("id") == place).first()["str"]


@dataclass
class QueryTemplate:
    """A plan-language query with placeholders, and the instances of their types."""

    query: Query
    candidates: list[Instances] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> QueryTemplate:
        query = parse_plan(text)
        if not placeholders(query):
            raise QueryError("a template needs a placeholder")
        return cls(query)

    def fill(self, engine: Engine) -> None:
        """Number each type's instances once, in order of their terms."""
        found = {kind: Instances(engine, kind) for kind in dict.fromkeys(placeholders(self.query))}
        self.candidates = [found[kind] for kind in placeholders(self.query)]

    def instantiate(self, seed: int) -> Query:
        """Each placeholder gets the instance at ``seed`` modulo their number."""
        values = iter([c[seed % len(c)] for c in self.candidates])

        def fill(pattern: Step) -> Step:
            if isinstance(pattern, Corun):
                return Corun(tuple(fill(p) for p in pattern.chain))
            if not isinstance(pattern, Pattern):
                return pattern
            return replace(pattern, **{k: next(values) for k in ("s", "p", "o") if isinstance(getattr(pattern, k), Placeholder)})

        return replace(self.query, where=Group([fill(s) for s in self.query.where.steps]))


@dataclass(frozen=True)
class MixEntry:
    path: str
    weight: int
    heavy: bool


def read_mix(text: str) -> list[MixEntry]:
    """``types heavy`` and then a path and a weight on each line; the last ``heavy`` are fixed queries."""
    types, heavy, *rest = text.split()
    count, fixed = int(types), int(heavy)
    if len(rest) < 2 * count:
        raise QueryError("the mix lists fewer queries than it says")
    return [MixEntry(rest[2 * i], int(rest[2 * i + 1]), i >= count - fixed) for i in range(count)]


@dataclass
class Log:
    """Seconds of queries by type, and what runs how fast."""

    latencies: dict[str, list[float]] = field(default_factory=dict)
    began: float = 0.0
    ended: float = 0.0

    def add(self, kind: str, seconds: float) -> None:
        self.latencies.setdefault(kind, []).append(seconds)

    def merge(self, other: Log) -> Log:
        out = Log({k: list(v) for k, v in self.latencies.items()}, min(self.began, other.began), max(self.ended, other.ended))
        for kind, values in other.latencies.items():
            out.latencies.setdefault(kind, []).extend(values)
        return out

    def percentile(self, kind: str, percent: float) -> float:
        values = sorted(self.latencies[kind])
        return values[min(len(values) - 1, int(len(values) * percent / 100))]

    def cdf(self, kind: str) -> list[tuple[int, float]]:
        """Percent and seconds at 25 points."""
        return [(p, self.percentile(kind, p)) for p in (1, *range(5, 96, 5), *range(96, 101))]

    def throughput(self) -> float:
        """Queries a second."""
        return sum(map(len, self.latencies.values())) / max(self.ended - self.began, 1e-9)

    def summary(self) -> dict[str, Any]:
        return {
            "throughput": self.throughput(),
            "queries": {k: {"n": len(v), "mean": statistics.fmean(v), "median": self.percentile(k, 50), "p99": self.percentile(k, 99)} for k, v in self.latencies.items()},
        }


def run_repeated(engine: Engine, text: str, times: int = 1, plan: bool = False) -> tuple[float, int]:
    """Mean seconds and number of rows of a query; rows aren't returned."""
    began, count = time.perf_counter(), 0
    for _ in range(times):
        count = (engine.plan(text) if plan else engine.sparql(text)).count()
    return (time.perf_counter() - began) / times, count


def run_mix(engine: Engine, entries: list[MixEntry], folder: str | Path, duration: float = 10.0, warm_up: float = 5.0, parallel: int = 20, heavy_parallel: int = 1, seed: int = 0) -> Log:
    """Keep up to ``parallel`` queries of a weighted mix in flight; those sent in the warm-up don't count."""
    ready: list[tuple[MixEntry, Callable[[int], Query]]] = []
    for entry in entries:
        text = (Path(folder) / entry.path).read_text()
        if entry.heavy:
            query = parse_plan(text)
            ready.append((entry, lambda _, q=query: q))
        else:
            template = QueryTemplate.parse(text)
            template.fill(engine)
            ready.append((entry, template.instantiate))
    choose, log, flying, heavy, ids = random.Random(seed), Log(), {}, 0, count_from(1)

    def run(query: Query, name: str) -> tuple[float, int]:
        began = time.perf_counter()
        # a group of its own, by which the jobs of a query can be told apart or cancelled
        engine.store.spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        count = engine.count(query)
        return time.perf_counter() - began, count

    start = time.perf_counter()
    log.began = start + warm_up
    with ThreadPoolExecutor(parallel) as pool:
        while (now := time.perf_counter()) < start + warm_up + duration:
            entry, make = choose.choices(ready, [e.weight for e, _ in ready])[0]
            if len(flying) < parallel and not (entry.heavy and heavy >= heavy_parallel):
                flying[pool.submit(run, make(choose.randrange(1 << 30)), f"{entry.path}-{next(ids)}")] = (entry, now)
                heavy += entry.heavy
            heavy -= _gathered(flying, log, 0.0 if len(flying) < parallel else None)
        while flying:
            _gathered(flying, log, None)
    log.ended = time.perf_counter()
    return log


def _gathered(flying: dict[Future, tuple[MixEntry, float]], log: Log, timeout: float | None) -> int:
    """Log what is done; the number of heavy queries among it."""
    done: Iterable[Future] = wait(flying, timeout=timeout, return_when=FIRST_COMPLETED).done
    heavy = 0
    for future in done:
        entry, sent = flying.pop(future)
        heavy += entry.heavy
        if sent >= log.began:
            log.add(entry.path, future.result()[0])
    return heavy
