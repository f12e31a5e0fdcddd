"""Tidewatch: labelled sensor data on Spark, from raw files to routed live records.

Every operator is a plain function from DataFrames to DataFrames. Sessions,
paths and thresholds are arguments; nothing here reads the environment.
"""
