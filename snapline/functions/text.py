"""Text rules: name repair, team codes, label parsing, header normalising."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .na import as_col, if_else

# Spelling rules from one naming scheme to the other. They run in this order, each over
# the result of the one before; a dot matches any character.
NAME_RULES = (
    ("Allen Robinson", "Allen Robinson II"),
    ("Allen Robinson II II", "Allen Robinson II"),
    ("Darrell Henderson", "Darrell Henderson Jr."),
    ("D.J. Moore", "DJ Moore"),
    ("Robby Anderson", "Robbie Anderson"),
    ("Marvin Jones", "Marvin Jones Jr."),
    ("D.J. Chark", "DJ Chark Jr."),
    ("Travis Etienne", "Travis Etienne Jr."),
    ("Melvin Gordon", "Melvin Gordon III"),
    ("Cedrick Wilson", "Cedrick Wilson Jr."),
    ("Jeffery Wilson", "Jeff Wilson Jr."),
    ("Jeffrey Wilson", "Jeff Wilson Jr."),
    ("Mark Ingram", "Mark Ingram II"),
    ("Mark Ingram II II", "Mark Ingram II"),
    ("Richie James", "Richie James Jr."),
    ("Kenneth Walker", "Kenneth Walker III"),
    ("Kenneth Walker III III", "Kenneth Walker III"),
)
TEAM_CODES = {"LA": "LAR"}
POSITION_OVERRIDES = {"Taysom Hill": "TE"}


def apply_rules(x: Column | str, rules=NAME_RULES) -> Column:
    """Run an ordered chain of pattern replacements over a text column."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, as_col(x))


def map_codes(x: Column | str, codes=TEAM_CODES) -> Column:
    x = as_col(x)
    return reduce(lambda c, kv: if_else(x == kv[0], F.lit(kv[1]), c), codes.items(), x)


def standard_names(
    df: DataFrame, name="name", team="team", position="position",
    rules=NAME_RULES, codes=TEAM_CODES, overrides=POSITION_OVERRIDES,
) -> DataFrame:
    """Repair names, then team codes, then the positions of named players."""
    df = df.withColumn(name, apply_rules(name, rules)).withColumn(team, map_codes(team, codes))
    fixed = F.col(position)
    for player, pos in overrides.items():
        fixed = if_else(F.col(name) == player, F.lit(pos), fixed)
    return df.withColumn(position, fixed)


def extract_first(x: Column | str, pattern: str) -> Column:
    """First match, null when there is none."""
    return F.regexp_substr(as_col(x), F.lit(pattern))


def remove_first(x: Column | str, pattern: str) -> Column:
    """Drop the first match only."""
    return F.regexp_replace(as_col(x), f"^(?s)(.*?)(?:{pattern})", "$1")


def trim_space(x: Column | str) -> Column:
    """Strip blanks, tabs and line ends on both sides."""
    return F.trim(as_col(x), F.lit(" \t\r\n"))


# How a roster label is read. The class runs from A to z and so also covers [ \ ] ^ _ `.
LABEL_PATTERN = "[A-z .'-]+ [0-9]"
LABEL_TAIL = " [0-9]"
LABEL_REPAIR = {"ers": "49ers"}


def player_from_label(label: Column | str) -> Column:
    """Name inside a label such as "A.J. Dillon 12"."""
    name = trim_space(remove_first(extract_first(label, LABEL_PATTERN), LABEL_TAIL))
    return map_codes(name, LABEL_REPAIR)


def snake(name: str) -> str:
    """Header text as a lower-case identifier."""
    text = re.sub(r"['\"]", "", name).replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    if not text:
        return "x"
    return f"x{text}" if text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case every column name; a repeated one gets _2, _3, ..."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        base = snake(column)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def columns_containing(df: DataFrame, patterns, but_not=()) -> list[str]:
    """Columns whose name holds any pattern (case ignored) and none of ``but_not``."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    but_not = [but_not] if isinstance(but_not, str) else list(but_not)
    picked = []
    for pattern in patterns:
        picked += [c for c in df.columns if pattern.lower() in c.lower() and c not in picked]
    return [c for c in picked if not any(p.lower() in c.lower() for p in but_not)]
