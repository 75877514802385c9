"""Multi-point observation analytics expressed as Spark plans."""
