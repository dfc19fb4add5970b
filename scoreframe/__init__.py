"""Reconciling noisy, positioned recognition output with sparse ground truth, on Spark DataFrames."""
