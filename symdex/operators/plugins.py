"""Plugins: functions of users over lines and symbols, registered by name and isolated from each other."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

@dataclass
class Plugin:
    """name, and a function (text, file, line) -> text or None over lines, or functions (name, description) -> text by kind over symbols."""

    name: str
    text_visitor: Callable[[str, str, int], str | None] | None = None
    symbol_visitor: dict[str, Callable[[str, str], str | None]] = field(default_factory=dict)
    start: Callable[[dict[str, str]], None] | None = None


_FAILED: set[str] = set()


def isolated(f: Callable, *args):
    """f(*args), or None if it fails; the first failure of each function in a process is logged."""
    try:
        return f(*args)
    except Exception as e:
        name = f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', f)}"
        if name not in _FAILED:
            _FAILED.add(name)
            log.warning("%s failed: %r", name, e)
        return None


def config_groups(settings: DataFrame) -> DataFrame:
    """(plugin, settings): ``plugin:setting=value`` texts as a map of each plugin; the last of a setting wins.  settings: seq, value.

    A plugin's settings are those of a command line, a few; texts without a colon are none.
    """
    c = F.col
    rest = F.expr("substring(value, instr(value, ':') + 1)")
    own = settings.where(c("value").contains(":")).select("seq", F.substring_index("value", ":", 1).alias("plugin"), F.substring_index(rest, "=", 1).alias("setting"), F.when(rest.contains("="), F.expr("substring(value, instr(value, ':') + 1 + instr(substring(value, instr(value, ':') + 1), '='))")).otherwise("").alias("v"))
    last = own.groupBy("plugin", "setting").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("plugin").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("setting", "v")))).alias("settings"))


class Registry:
    """Plugins that aren't denied, each started with its own settings; one that can't start is left out."""

    def __init__(self, denied: tuple[str, ...] = (), settings: dict[str, dict[str, str]] | None = None):
        self.denied, self.settings, self.plugins = set(denied), settings or {}, {}

    def add(self, plugin: Plugin) -> bool:
        if plugin.name in self.denied:
            return False
        if plugin.start is not None:
            try:
                plugin.start(self.settings.get(plugin.name, {}))
            except Exception:
                log.exception("%s can't start", plugin.name)
                return False
        self.plugins[plugin.name] = plugin
        return True

    def register(self, spark: SparkSession) -> None:
        """Line visitors as SQL functions."""
        for plugin in self.plugins.values():
            if plugin.text_visitor is not None:
                spark.udf.register(plugin.name, _line_udf(plugin.text_visitor))

    def visit_lines(self, lines: DataFrame) -> DataFrame:
        """(file, line, plugin, glyph) for every answer.  lines: file, line, text."""
        c = F.col
        each = [F.struct(F.lit(p.name).alias("plugin"), _line_udf(p.text_visitor)(c("text"), c("file"), c("line")).alias("glyph")) for p in self.plugins.values() if p.text_visitor]
        if not each:
            return lines.select("file", "line", F.lit("").alias("plugin"), F.lit("").alias("glyph")).limit(0)
        return lines.select("file", "line", F.explode(F.array(*each)).alias("x")).select("file", "line", "x.*").where("glyph is not null")

    def visit_symbols(self, symbols: DataFrame) -> DataFrame:
        """(id, plugin, answer): each symbol goes to the function of its kind.  symbols: id, kind, name, description."""
        c = F.col
        each = []
        for p in self.plugins.values():
            for kind, f in p.symbol_visitor.items():
                each.append(F.struct(F.lit(p.name).alias("plugin"), F.when(c("kind") == kind, _symbol_udf(f)(c("name"), c("description"))).alias("answer")))
        if not each:
            return symbols.select("id", F.lit("").alias("plugin"), F.lit("").alias("answer")).limit(0)
        return symbols.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.*").where("answer is not null")


def _line_udf(f: Callable[[str, str, int], str | None]) -> Callable[..., Column]:
    @F.pandas_udf("string")
    def run(text: pd.Series, file: pd.Series, line: pd.Series) -> pd.Series:
        return pd.Series([isolated(f, *x) for x in zip(text, file, line, strict=True)], dtype="object")

    return run


def _symbol_udf(f: Callable[[str, str], str | None]) -> Callable[..., Column]:
    @F.pandas_udf("string")
    def run(name: pd.Series, description: pd.Series) -> pd.Series:
        return pd.Series([isolated(f, *x) for x in zip(name, description, strict=True)], dtype="object")

    return run
