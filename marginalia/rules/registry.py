"""The rules: what they are called, what they need, and the kinds of documents they are for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds a document may have; ``generated`` only by mapping.
KINDS = ("readme", "howto", "reference", "runbook", "agents", "adr", "plan", "changelog", "generated")
LONG_LIVED = ("readme", "howto", "reference", "runbook", "agents")
# Kinds by scope. ``any`` also covers documents without a kind.
SCOPES = {
    "any": KINDS[:-1], "declared": KINDS[:-1], "long-lived": LONG_LIVED, "except-changelog": tuple(k for k in KINDS[:-1] if k != "changelog"),
    "howto-or-reference": ("howto", "reference"), "howto-or-runbook": ("howto", "runbook"), "procedural": ("howto", "reference", "runbook"),
}
# Code, name, stable, scope, and whether the rule looks beyond one document.
RULES = [
    ("STL001", "current-value-snapshot", False, "long-lived", False),
    ("STL002", "deployment-state-assertion", False, "long-lived", False),
    ("STL003", "commit-snapshot", False, "long-lived", False),
    ("STL004", "unconstrained-version", False, "long-lived", False),
    ("RAT001", "rationale-before-procedure", False, "howto-or-reference", False),
    ("RAT002", "design-choice-heading", False, "howto-or-reference", False),
    ("ORD001", "long-preamble", False, "howto-or-runbook", False),
    ("ORD002", "exceptions-before-procedure", False, "howto-or-runbook", False),
    ("MIX001", "conflicting-section-role", False, "procedural", False),
    ("VOX001", "requester-conversation", False, "long-lived", False),
    ("VOX002", "excluded-scope-heading", False, "long-lived", False),
    ("VOX003", "production-narration", False, "long-lived", False),
    ("EVD001", "unsupported-evaluation", False, "declared", False),
    ("KND001", "missing-document-kind", True, "any", False),
    ("KND002", "invalid-document-kind", True, "any", False),
    ("PTR001", "repository-root-pointer", False, "except-changelog", False),
    ("PTR002", "directory-pointer", False, "except-changelog", True),
    ("PTR003", "unspecified-source-pointer", False, "declared", False),
    ("LNK001", "missing-local-link-target", True, "any", False),
    ("LNK002", "missing-local-anchor", False, "any", True),
    ("SUP001", "invalid-suppression", True, "any", False),
    ("SUP002", "unused-suppression", True, "any", False),
    ("DUP001", "repeated-definitions", False, "declared", True),
    ("DUP002", "repeated-content-pointer", False, "declared", True),
    ("DUP003", "similar-paragraphs", False, "declared", True),
    ("OWN001", "plan-definition-overlap", False, "declared", True),
    ("OWN002", "ambiguous-owner", False, "declared", True),
]
CODES = tuple(r[0] for r in RULES)
FAMILIES = tuple(sorted({c[:3] for c in CODES}))


def rule_table(spark: SparkSession) -> DataFrame:
    """Rows (code, family, name, stable, scope, workspace)."""
    rows = [(c, c[:3], n, s, k, w) for c, n, s, k, w in RULES]
    return spark.createDataFrame(rows, "code string, family string, name string, stable boolean, scope string, workspace boolean")


def applies(scope: Column, kind: Column) -> Column:
    """Whether a scope covers a kind (null: none)."""
    out = F.lit(False)
    for name, kinds in SCOPES.items():
        out = F.when(scope == name, F.coalesce(kind.isin(*kinds), F.lit(name == "any"))).otherwise(out)
    return out


def register_rule(code: str, name: str, scope: str = "any", workspace: bool = False, stable: bool = False) -> None:
    """Adds a rule of one's own to the table (an addition: its diagnostics are unioned by ``plans.check``)."""
    global CODES, FAMILIES
    if code in CODES or scope not in SCOPES:
        raise ValueError(f"{code}: known already, or of an unknown scope {scope}")
    RULES.append((code, name, stable, scope, workspace))
    CODES, FAMILIES = tuple(r[0] for r in RULES), tuple(sorted({r[0][:3] for r in RULES}))
