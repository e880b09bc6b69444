"""Cohort genotype and evidence-audit analytics on Spark DataFrames."""
