"""veilmark: PII detection, masking, reinjection and audit analytics on Spark DataFrames."""

__version__ = "0.1.0"
