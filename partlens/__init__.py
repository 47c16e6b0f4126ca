"""Inspection analytics over Spark DataFrames: cells, boxes, readings, regions and capture events."""
