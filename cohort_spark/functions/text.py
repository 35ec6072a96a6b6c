"""String functions: keyword flags, feature names, token overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How abbreviations of measurements are written out.
ABBREVIATIONS = {
    "map": "MAP",
    "spo2": "SpO2",
    "fio2": "FiO2",
    "peep": "PEEP",
    "wbc": "WBC",
    "hr": "heart rate",
    "rr": "respiratory rate",
    "sbp": "systolic blood pressure",
    "dbp": "diastolic blood pressure",
}
#: Statistic prefixes, rolling-window statistics, role prefixes and suffixes of feature names.
STATISTICS = ("last", "mean", "std", "min", "max")
ROLLING = ("mean", "std", "min", "max", "sum")
ROLES = ("has", "early", "high", "total")
SUFFIXES = ("obs", "flag", "mask", "ml", "hrs", "first", "last", "invasive", "noninvasive")


def any_keyword(column: Column, keywords) -> Column:
    """1 if the column contains one of ``keywords`` in any case, else 0; null counts as 0."""
    low, hit = F.lower(column), F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    return F.coalesce(hit, F.lit(False)).cast("int")


def normalize_feature_name(name: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """A readable name: what follows the last colon, without statistic prefix, rolling-window marks (anywhere), role prefix
    and suffix; ``_`` becomes a space and a known abbreviation, in any case, is written out."""
    out = F.element_at(F.split(name, ":"), -1)
    for pattern in (rf"^({'|'.join(STATISTICS)})_", rf"_?roll({'|'.join(ROLLING)})_?\d*", rf"^({'|'.join(ROLES)})_", rf"_({'|'.join(SUFFIXES)})$"):
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(F.regexp_replace(out, "_", " "))
    table = F.create_map(*[F.lit(x) for kv in abbreviations.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(out)), out)


def label_anchor(label: Column, suffix: str = "ICU") -> Column:
    """``label_x_y`` as ``x y`` and the suffix."""
    return F.concat(F.regexp_replace(F.regexp_replace(label, "^label_", ""), "_", " "), F.lit(f" {suffix}"))


def tokens(column: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"\s+"), lambda x: x != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def base_name(feature: Column, statistics=STATISTICS) -> Column:
    """The feature without its statistic prefix."""
    return F.regexp_replace(feature, rf"^({'|'.join(map(re.escape, statistics))})_", "")
