"""Planning before anything is read: which rules run, and what they need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that look beyond one document.
WORKSPACE_RULES = frozenset({"LNK001", "LNK002", "PTR002", "DUP001", "DUP002", "DUP003", "OWN001", "OWN002"})


@dataclass(frozen=True)
class Plan:
    rules: frozenset[str]
    needs_workspace: bool
    paths: tuple[str, ...]

    @property
    def read_paths(self) -> tuple[str, ...]:
        """Paths to read: all of them (none named) if a rule needs the whole workspace."""
        return () if self.needs_workspace else self.paths


def plan(enabled: set[str], paths: list[str]) -> Plan:
    return Plan(frozenset(enabled), bool(enabled & WORKSPACE_RULES), tuple(paths))


def asked(filename: Column, paths: list[str]) -> Column:
    """Whether a file is one of the paths or below one, by whole components; no path, or a dot, asks for all."""
    if not paths or "" in paths or "." in paths:
        return F.lit(True)
    out = F.lit(False)
    for p in (x.rstrip("/") for x in paths):
        out |= (filename == p) | F.startswith(filename, F.lit(p + "/"))
    return out


def visible(diagnostics: DataFrame, paths: list[str]) -> DataFrame:
    """Diagnostics (doc, related, ...) whose document, or a related one, was asked for."""
    return diagnostics.where(asked(F.col("doc"), paths) | F.exists(F.coalesce("related", F.array().cast(diagnostics.schema["related"].dataType)), lambda r: asked(r["filename"], paths)))
