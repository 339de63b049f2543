"""Transcript data-set preparation and classifier evaluation on Spark DataFrames."""
