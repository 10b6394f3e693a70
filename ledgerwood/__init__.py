"""Ledgerwood: document and claims analytics as Spark DataFrames."""
