"""The expected results as SQL, written for another engine and independent of the Spark code."""
