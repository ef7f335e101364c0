"""License matching, snippet provenance and training-data operators on Spark."""
