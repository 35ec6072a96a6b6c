"""Cohort features, drift audits, model evaluation and retrieval stability as Spark DataFrame jobs."""
