"""Metagenomics operations analytics as Spark jobs.

Every operator takes DataFrames plus parameters and returns a DataFrame. Nothing reads the
clock: ``now``, ages, capacities and thresholds are arguments.
"""
