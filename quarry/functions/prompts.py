"""Prompt text columns: ``{name}`` templates filled from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed prompt templates that must match the reference wording.
ROLE_PLAY_SYSTEM_TEMPLATE = (
    "{profile}"
    "\n\n"
    "你将依照如下情节，与其他角色对话：\n"
    "---------------------\n"
    "{context}\n"
    "---------------------\n"
)
QUESTION_ANSWER_SYSTEM_TEMPLATE = "{profile}" "\n\n" "你将与用户展开日常对话。\n"


def render(template: str, **cols: Column) -> Column:
    """Substitute ``{name}`` placeholders with columns; unknown placeholders stay literal.

    The template is split once on the driver, so the result is a single ``concat``.
    Null inputs render as empty text.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i)
        if i < 0 or j < 0:
            parts.append(F.lit(rest))
            break
        name = rest[i + 1:j]
        if name in cols:
            parts.append(F.lit(rest[:i]))
            parts.append(F.coalesce(cols[name].cast("string"), F.lit("")))
        else:
            parts.append(F.lit(rest[:j + 1]))
        rest = rest[j + 1:]
    return F.concat(*parts) if parts else F.lit("")


def numbered(items: Column, sep: str = "\n") -> Column:
    """``1. a<sep>2. b``: numbered feedback lists."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), sep)
