"""Experiment, uplift and customer analytics on Spark DataFrames."""
