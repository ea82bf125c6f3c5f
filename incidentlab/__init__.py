"""Incident-record analytics on Spark DataFrames."""
