"""Chat-governance analytics and text-corpus operators on Spark."""
