"""Several named sources of the same three tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F


class Tables:
    """The tables of one source, each opened when it is first used."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load

    @cached_property
    def activity(self) -> DataFrame:
        return self._load("activity")

    @cached_property
    def activity_input(self) -> DataFrame:
        return self._load("activity_input")

    @cached_property
    def log_entries(self) -> DataFrame:
        return self._load("log_entries")


Query = Callable[[Tables], DataFrame]


class SourceRegistry:
    """Sources by name.

    Names are looked up without case and outer blanks, so two that differ in
    nothing else are refused; a blank name means the default, which is the first source unless another is named.
    """

    def __init__(self, sources: Mapping[str, Tables], default: str | None = None):
        if not sources:
            raise ValueError("sources: there are none")
        self._sources: dict[str, tuple[str, Tables]] = {}
        for name, tables in sources.items():
            key = name.strip().lower()
            if not key or key in self._sources:
                raise ValueError(f"sources: the name '{name}' is blank or taken")
            self._sources[key] = (name.strip(), tables)
        self.default = (default or next(iter(sources))).strip()
        self.resolve(self.default)

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self._sources.values()]

    def resolve(self, name: str | None) -> tuple[str, Tables]:
        wanted = self.default if name is None or not name.strip() else name.strip()
        if wanted.lower() not in self._sources:
            raise ValueError(f"source: '{name}' is none of {', '.join(self.names)}")
        return self._sources[wanted.lower()]

    def run(self, query: Query, source: str | None = None) -> DataFrame:
        """The query's rows for one source, each with the source's name."""
        name, tables = self.resolve(source)
        return query(tables).withColumn("source", F.lit(name))

    def run_all(self, query: Query) -> DataFrame:
        """The same for every source, in one job."""
        return reduce(DataFrame.unionByName, [self.run(query, name) for name in self.names])
