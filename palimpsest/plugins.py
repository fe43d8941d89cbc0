"""Plugins: steps before and after elements are made, from DataFrame to DataFrame, in the order that a book names them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import noise

Step = Callable[[DataFrame, dict[str, Any]], DataFrame]
log = logging.getLogger("palimpsest")


@dataclass
class Plugin:
    """before gets pages, after gets elements; either may be missing."""

    before: Step | None = None
    after: Step | None = None


@dataclass
class Registry:
    known: dict[str, Plugin] = field(default_factory=dict)

    def register(self, name: str, before: Step | None = None, after: Step | None = None) -> None:
        self.known[name] = Plugin(before, after)

    def _chosen(self, names: list[str], strict: bool) -> list[tuple[str, Plugin]]:
        out = []
        for n in names:
            if n in self.known:
                out.append((n, self.known[n]))
            elif strict:
                raise KeyError(f"no plugin {n!r}")
            else:
                log.warning("no plugin %r; it is left out", n)
        return out

    def run(self, phase: str, df: DataFrame, names: list[str], settings: dict[str, dict[str, Any]] | None = None, strict: bool = False) -> DataFrame:
        """df after the step of each named plugin for the phase, 'before' or 'after'. Unknown names are left out with a warning, or raise a KeyError."""
        for name, plugin in self._chosen(names, strict):
            step = getattr(plugin, phase)
            if step:
                df = step(df, (settings or {}).get(name, {}))
        return df


def tag_scripts(elements: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """elements with script_lang; settings may have glyphs: {language: regular expression} that win over the known scripts."""
    return elements.withColumn("script_lang", noise.tagged_script(F.col("text"), F.col("kind"), settings.get("glyphs")))


registry = Registry()
registry.register("script_detect", after=tag_scripts)
