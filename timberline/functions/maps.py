"""Field maps: key=value extraction, renaming, enrichment, named groups of patterns."""

from __future__ import annotations

import os
import socket
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.regex import to_java

KV = r'(?<![^\s])([^\s=]+)=("[^"]*"(?![^\s])|[^\s]+)'


def last_of_keys(items: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """A map of an array's items; of equal keys the last counts. One sort; arrays of one item name what is computed once."""

    def sorted_of(xs: Column) -> Column:
        return F.array_sort(F.transform(xs, lambda e, i: F.struct(key(e).alias("key"), i.alias("i"), value(e).alias("value"))))

    def last(s: Column) -> Column:
        kept = F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["key"] != e["key"], F.lit(True)))
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))

    return F.get(F.transform(F.array(sorted_of(items)), last), 0)


def overlay(fields: Column, extra: Column) -> Column:
    """fields (null: none) with the entries of extra put over them."""
    base = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    names = F.map_keys(extra)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(names, k)), extra)


def extract_kv(message: Column, *names: str) -> Column:
    """key=value tokens of a message; quoted values may hold blanks; the last of equal keys wins; only ``names`` if given.

    A token counts if its = is neither first nor last. A null message gives an empty map.
    """
    tokens = F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(KV), 0)
    found = last_of_keys(tokens, lambda t: F.substring_index(t, "=", 1), lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^=]*=", ""), r'^"+|"+$', ""))
    return F.map_filter(found, lambda k, _: k.isin(*names)) if names else found


@dataclass(frozen=True)
class Rename:
    """Keys equal to ``source`` (case apart) become ``target``; transform maps a Column of values to another."""

    source: str
    target: str
    transform: Callable[[Column], Column] | None = None


def normalize(fields: Column, rules: Sequence[Rename]) -> Column:
    """Renames keys and transforms values; of two rules for a key the last counts; other keys stay; null stays null."""
    by = {r.source.lower(): r for r in rules}

    def key(e: Column) -> Column:
        out = e["key"]
        for name, rule in by.items():
            out = F.when(F.lower(e["key"]) == name, rule.target).otherwise(out)
        return out

    def value(e: Column) -> Column:
        out = e["value"]
        for name, rule in by.items():
            if rule.transform:
                out = F.when(F.lower(e["key"]) == name, rule.transform(e["value"])).otherwise(out)
        return out

    return last_of_keys(F.map_entries(fields), key, value)


def static(values: Mapping[str, str]) -> Callable[[], Column]:
    """A provider of fixed fields; the mapping is copied."""
    held = dict(values)
    return lambda: F.create_map(*[F.lit(x) for kv in held.items() for x in kv]).cast("map<string,string>")


def host(key: str = "host") -> Callable[[], Column]:
    """A provider of this machine's name, looked up once."""
    try:
        name = socket.gethostname()
    except OSError:
        name = "unknown"
    return static({key: name or "unknown"})


def env(names: Sequence[str], aliases: Mapping[str, str] | None = None) -> Callable[[], Column]:
    """A provider of environment variables that are set, under their alias if there is one."""
    return lambda: static({(aliases or {}).get(n) or n: os.environ[n] for n in names if n in os.environ})()


def enrich(fields: Column, *providers: Callable[[], Column]) -> Column:
    """Each provider's fields over the former ones, in order."""
    for p in providers:
        fields = overlay(fields, p())
    return fields


class LinePattern:
    """A named pattern whose named groups are fields."""

    def __init__(self, name: str, pattern: str):
        if not name:
            raise ValueError("a pattern needs a name")
        self.name, self.java = name, to_java(pattern)
        if not any(self.java.names):
            raise ValueError(f"pattern {name!r} has no named group")

    @property
    def fields(self) -> list[str]:
        return [n for n in self.java.names if n]

    def match(self, raw: Column) -> Column:
        """A map of all named groups ("" for one that took no part), or null if the pattern isn't found."""
        line = F.regexp_replace(raw, r"\n\z", "")
        cells = [x for i, n in enumerate(self.java.names, 1) if n for x in (F.lit(n), F.coalesce(F.regexp_extract(line, self.java.text, i), F.lit("")))]
        return F.when(line.rlike(self.java.text), F.create_map(*cells))


class PatternRegistry:
    """Patterns by name, tried in the order of registration."""

    def __init__(self):
        self._by: dict[str, LinePattern] = {}

    def register(self, pattern: LinePattern) -> None:
        if pattern is None:
            raise ValueError("no pattern")
        if pattern.name in self._by:
            raise ValueError(f"pattern {pattern.name!r} is registered already")
        self._by[pattern.name] = pattern

    def get(self, name: str) -> LinePattern | None:
        return self._by.get(name)

    def names(self) -> list[str]:
        return list(self._by)

    def match_first(self, raw: Column) -> Column:
        """struct(name, fields) of the first pattern found, or null."""
        kinds = [F.when(p.match(raw).isNotNull(), F.struct(F.lit(p.name).alias("name"), p.match(raw).alias("fields"))) for p in self._by.values()]
        return F.coalesce(*kinds) if kinds else F.lit(None).cast("struct<name:string,fields:map<string,string>>")
