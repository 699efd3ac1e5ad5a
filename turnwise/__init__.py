"""Chat-corpus and speculative-decoding analytics as Spark DataFrame jobs."""
