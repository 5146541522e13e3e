"""Document backfill and gap-detection engine on Spark DataFrames."""
