"""Evidence-based effort analytics expressed as Spark DataFrame pipelines."""
