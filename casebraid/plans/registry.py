"""The registry that feeds queries() and oracle_sql(), and the order of dependent stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers (spark, sf_dir) -> DataFrame under name, with the same query in DuckDB's SQL."""

    def put(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return put


@dataclass
class Stage:
    """A named step with what must and what should run before it (EXT-01)."""

    name: str
    run: Callable[..., object]
    needs: tuple[str, ...] = ()
    likes: tuple[str, ...] = ()
    modes: tuple[str, ...] = ("batch",)


@dataclass
class Stages:
    """EXT-02, EXT-03: stages in an order where each comes after all it needs."""

    known: dict[str, Stage] = field(default_factory=dict)

    def add(self, stage: Stage) -> Stage:
        self.known[stage.name] = stage
        return stage

    def resolve(self, names: list[str]) -> list[Stage]:
        """Needed stages come first; a missing name is a KeyError and a circle a ValueError."""
        order: list[str] = []
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in order:
                return
            if name in open_:
                raise ValueError("circular stages: " + " -> ".join([*open_[open_.index(name) :], name]))
            if name not in self.known:
                raise KeyError(name)
            open_.append(name)
            for need in self.known[name].needs:
                visit(need)
            order.append(open_.pop())

        for name in names:
            visit(name)
        return [self.known[n] for n in order]

    def warnings(self, names: list[str]) -> list[str]:
        """Stages that would like another one before them which is not among the chosen."""
        chosen = {s.name for s in self.resolve(names)}
        return [f"{s.name} runs without {like}" for s in self.resolve(names) for like in s.likes if like not in chosen]

    def check_mode(self, names: list[str], mode: str) -> None:
        for stage in self.resolve(names):
            if mode not in stage.modes:
                raise ValueError(f"{stage.name} has no mode {mode}")
