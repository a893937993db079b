"""Labelled voxel volumes as Spark DataFrames."""
