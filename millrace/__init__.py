"""Millrace: content analytics over file inventories and documents, on Spark DataFrames."""
