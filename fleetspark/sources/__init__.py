"""Scans of fleet data into DataFrames."""
