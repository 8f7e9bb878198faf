"""Contract analytics on PySpark: cleaning, matching, panels, rankings and valuations."""
