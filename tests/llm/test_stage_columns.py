"""Pipeline stages keep columns whose names are those of their own counts."""

from pyspark.sql import functions as F

from cohort_spark.llm import quality_rules

from .test_operators import SF


def test_quality_stage_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(-5) for c in ("n_words", "kept", "base_failed", "_facts", "stratum")})
    out = quality_rules.stage(spark, docs, SF)
    assert out.columns == docs.columns
    row = out.agg(F.count("*"), F.min("n_words"), F.max("n_words"), F.min("kept"), F.min("stratum")).first()
    assert row[0] > 0 and list(row)[1:] == [-5, -5, -5, -5]
