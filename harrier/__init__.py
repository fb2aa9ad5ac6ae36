"""Event surveillance analytics on Spark: DataFrame plans for every stage from raw sightings to read models."""
