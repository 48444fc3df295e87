"""Rules that users put before, or in place of, the branches of a plan's table of decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions after which a directory is there and what lies in it is visited.
ENTERED = ("mkdir", "reuse_dir", "replace")


@dataclass(frozen=True)
class Rule:
    """Gives an entry `action` where `when` holds (SQL text or a column over rel_path, kind, size and the plan's other columns), whatever the table says, or with `of` only in place of these actions of the table."""

    name: str
    when: str | Column
    action: str
    of: tuple[str, ...] = ()

    def holds(self) -> Column:
        hit = F.coalesce(F.expr(self.when) if isinstance(self.when, str) else self.when, F.lit(False))
        return hit & F.col("action").isin(*self.of) if self.of else hit


#: The first rule that holds decides.
Policy = tuple[Rule, ...]


def first_rule(policy: Policy, of: str) -> Column:
    """The name or action of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(policy):
        out = F.when(rule.holds(), F.lit(getattr(rule, of))).otherwise(out)
    return out


def decide(plan: DataFrame, policy: Policy) -> DataFrame:
    """plan with the rules' actions, and the name of the rule that decided as column `rule` (null: the table)."""
    asked = plan.withColumns({"rule": first_rule(policy, "name"), "_by_rule": first_rule(policy, "action")})
    return asked.withColumn("action", F.coalesce("_by_rule", "action")).drop("_by_rule")


def left_out(plan: DataFrame) -> DataFrame:
    """(rel_path): directories that a rule keeps from being made or entered."""
    return plan.where((F.col("kind") == "dir") & F.col("rule").isNotNull() & ~F.col("action").isin(*ENTERED)).select("rel_path")
