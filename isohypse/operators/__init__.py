"""Operators on rasters, segments, polygons and labels: functions from DataFrames to DataFrames."""
