"""Gradus: evaluation analytics for multiple-choice model runs, on Spark DataFrames."""
