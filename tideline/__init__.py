"""Tideline: point-in-time analytics over corporate facts, built on Spark DataFrames."""
