"""Column expressions on user agents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import (
    AGENT_FAMILY_RULES, BOT, BOT_AGENT_PATTERNS, BOT_FAMILY_RULES, BROWSER_TOKENS,
    PREVIEW_AGENT_PATTERNS,
)


def _matches_any(agent: Column, patterns: list[str]) -> Column:
    return F.coalesce(F.lower(agent).rlike("(?i)" + "|".join(patterns)), F.lit(False))


def is_suspect_agent(agent: Column, patterns: list[str] | None = None) -> Column:
    return _matches_any(agent, patterns or BOT_AGENT_PATTERNS)


def is_preview_agent(agent: Column) -> Column:
    return _matches_any(agent, PREVIEW_AGENT_PATTERNS)


def is_browser_like(agent: Column) -> Column:
    return _matches_any(agent, BROWSER_TOKENS)


def _first_rule(lowered: Column, rules: list[tuple[str, str]]) -> Column:
    (family, pattern), *rest = rules
    choice = F.when(lowered.rlike(pattern), F.lit(family))
    for family, pattern in rest:
        choice = choice.when(lowered.rlike(pattern), F.lit(family))
    return choice


def agent_family(agent: Column) -> Column:
    text = F.coalesce(agent, F.lit(""))
    return (
        F.coalesce(
            _first_rule(F.lower(text), AGENT_FAMILY_RULES),
            F.when(is_browser_like(text), F.lit("browser_like")),
            F.when(text == "", F.lit("missing")),
            F.lit("other"),
        )
    )


def bot_family(agent: Column, label: Column) -> Column:
    family = F.coalesce(
        _first_rule(F.lower(F.coalesce(agent, F.lit(""))), BOT_FAMILY_RULES), F.lit("generic_bot")
    )
    return F.when(label == BOT, family).otherwise(F.lit("human"))
