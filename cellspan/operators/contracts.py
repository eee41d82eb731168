"""Declared rules for tables: all rules on rows are one aggregate of a table; keys and references take a shuffle each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One rule; ``column`` may be several names with commas between them for unique and reference.

    kinds: required (not null, not blank), positive, not_negative, fraction (0 to 1), member (arg: the values), matches (arg: a pattern), holds
    (column: a condition in SQL), unique (no value twice), reference (arg: the name of a table that has the same columns).  A null breaks
    every rule on rows; unique and reference pass over rows with a null in their columns.
    """

    kind: str
    column: str
    arg: object = None
    name: str | None = None

    @property
    def title(self) -> str:
        return self.name or f"{self.kind}:{self.column}"

    @property
    def names(self) -> list[str]:
        return [c.strip() for c in self.column.split(",")]


def broken(rule: Rule) -> Column:
    """Whether a row breaks a rule on rows."""
    c = F.expr(rule.column) if rule.kind == "holds" else F.col(rule.column)
    number = c.cast("double")
    ok = {
        "required": lambda: F.trim(c.cast("string")) != "",
        "positive": lambda: (number > 0) & ~F.isnan(number),
        "not_negative": lambda: (number >= 0) & ~F.isnan(number),
        "fraction": lambda: number.between(0, 1),
        "member": lambda: c.isin(*rule.arg),
        "matches": lambda: c.rlike(rule.arg),
        "holds": lambda: c,
    }[rule.kind]()
    return ~F.coalesce(ok, F.lit(False))


def check(df: DataFrame, rules: list[Rule], key: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, n, sample) for every rule: the rows that break it, and the smallest key among them (as text).

    Of a value that is there k times, k - 1 rows break a unique rule; its sample is the value.  An empty table breaks nothing.
    """
    row_rules, rest = [r for r in rules if r.kind not in ("unique", "reference")], [r for r in rules if r.kind in ("unique", "reference")]
    label, parts = F.col(key).cast("string"), []
    if row_rules:
        one = df.agg(*(a for i, r in enumerate(row_rules) for a in (F.count_if(broken(r)).alias(f"n{i}"), F.min(F.when(broken(r), label)).alias(f"s{i}"))))
        parts.append(one.select(F.inline(F.array(*(F.struct(F.lit(r.title).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sample")) for i, r in enumerate(row_rules))))))
    for r in rest:
        there = df.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in r.names)))
        if r.kind == "unique":
            twice = there.groupBy(*r.names).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
            found = twice.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"), F.min(F.concat_ws(",", *r.names)).alias("sample"))
        else:
            lost = there.join(tables[r.arg].select(*r.names), r.names, "left_anti")
            found = lost.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("sample"))
        parts.append(found.select(F.lit(r.title).alias("rule"), "n", "sample"))
    return reduce(DataFrame.unionByName, parts)


# Where a scene's cell may come from, and how its section may lie.
CELL_SOURCES = ("observed_anchor", "observed_low_quality", "mined_partial", "inferred_latent", "tx_inferred", "synthetic")
SECTION_STATES = ("full", "nucleus_rich", "nucleus_poor", "membrane_only", "sliver", "unknown", "apex_above", "base_below", "fragment_top", "fragment_bottom")


def scene_rules(sources: tuple[str, ...] = CELL_SOURCES, states: tuple[str, ...] = SECTION_STATES) -> list[Rule]:
    """The rules of a scene's cells: names and labels once a scene, labels that are in the image, known sources and states, efficiencies and shares in bounds.

    check() wants the tables ``pixels`` (scene_id, label) and ``nuclei`` (scene_id, nucleus_label) with them.
    """
    return [
        Rule("required", "cell_id"), Rule("unique", "scene_id, cell_id"), Rule("positive", "label"), Rule("unique", "scene_id, label"), Rule("reference", "scene_id, label", "pixels"),
        Rule("member", "source", sources), Rule("member", "sectioning_state", states), Rule("fraction", "segmentation_reliability"), Rule("fraction", "visibility_fraction"),
        Rule("not_negative", "membrane_efficiency"), Rule("not_negative", "dapi_efficiency"), Rule("reference", "scene_id, nucleus_label", "nuclei"),
    ]


def ground_truth_rules() -> list[Rule]:
    """What a written table of true cells must keep: one row a cell, a type that is known, a confidence in bounds, evidence that is JSON."""
    return [
        Rule("required", "cell_id"), Rule("unique", "cell_id"), Rule("holds", "lower(trim(cell_type)) not in ('', 'unknown', 'nan')", name="known type"),
        Rule("required", "source"), Rule("fraction", "confidence"), Rule("holds", "try_parse_json(evidence) is not null", name="evidence is JSON"),
    ]


def require(violations: DataFrame) -> None:
    """An error that names the broken rules, if there are any."""
    bad = violations.where("n > 0").collect()  # a row for each rule
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} rows, such as {r['sample']}" for r in sorted(bad)))
