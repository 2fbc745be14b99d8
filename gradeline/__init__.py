"""Scoring, evaluation and score-fusion toolkit for binary outcomes on Spark DataFrames."""

__version__ = "0.1.0"
