"""Who is in the cohort: demographics, code flags, eligibility, flat signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeRule:
    """A flag for codes: prefixes by version, and closed ranges of leading characters."""

    name: str
    prefixes: dict[int, tuple[str, ...]]
    ranges: dict[int, tuple[tuple[str, str], ...]] | None = None


def demographics(stays: DataFrame, patients: DataFrame, admissions: DataFrame | None = None, subject: str = "subject_id", admission: str = "hadm_id") -> DataFrame:
    """Stays with patient (and admission) columns and age = anchor age + years since the anchor year."""
    out = stays.join(patients, subject)
    if admissions is not None:
        out = out.join(admissions, admission)
    return out.withColumn("age", F.col("anchor_age") + F.year("intime") - F.col("anchor_year"))


def code_flags(codes: DataFrame, rules: list[CodeRule], key: str = "hadm_id", code: str = "icd_code", version: str | None = "icd_version") -> DataFrame:
    """(key, a 0/1 flag for each rule): whether any of the key's codes fits."""

    def fits(r: CodeRule) -> Column:
        hit = F.lit(False)
        for v, prefixes in r.prefixes.items():
            here = F.lit(False)
            for p in prefixes:
                here = here | F.col(code).startswith(p)
            for low, high in (r.ranges or {}).get(v, ()):
                here = here | F.substring(code, 1, len(low)).between(low, high)
            hit = hit | (here & (F.col(version) == v) if version else here)
        return F.coalesce(hit, F.lit(False))

    return codes.groupBy(key).agg(*[F.max(fits(r).cast("int")).alias(r.name) for r in rules])


def eligible(stays: DataFrame, shortest_hours: float = 14, eras: list[str] | None = None, id_col: str = "stay_id", era: str = "era", labels: list[str] = ()) -> DataFrame:
    """Stays of a known era with a positive id and labels, long enough, whose subject neither died nor left before
    ``shortest_hours``."""
    until = F.unix_micros(F.col("intime").cast("timestamp")) + int(shortest_hours * 3.6e9)

    def later(c: str) -> Column:
        return F.col(c).isNull() | (F.unix_micros(F.col(c).cast("timestamp")) > until)

    ok = F.col(id_col) > 0
    for c in ("deathtime", "outtime"):
        if c in stays.columns:
            ok = ok & later(c)
    if "los_hours" in stays.columns:
        ok = ok & (F.col("los_hours") >= shortest_hours)
    if eras:
        ok = ok & F.col(era).isin(eras)
    for c in labels:
        ok = ok & F.col(c).isNotNull()
    return stays.where(ok)


def drop_flat(df: DataFrame, signals: list[str], key: str = "stay_id") -> DataFrame:
    """``df`` without the keys all of whose observed signals are flat: sample deviation 0, or one value only. Keys with no
    signal observed at all stay."""
    stats = df.groupBy(key).agg(*[x for c in signals for x in (F.stddev_samp(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))])
    flat, some = F.lit(True), F.lit(False)
    for c in signals:
        flat = flat & ((F.col(f"_n_{c}") == 0) | F.col(f"_s_{c}").isNull() | (F.col(f"_s_{c}") == 0))
        some = some | (F.col(f"_n_{c}") > 0)
    return df.join(stats.where(flat & some).select(key), key, "left_anti")
