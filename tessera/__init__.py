"""Evidence-based entity scoring and its surrounding analytics as Spark DataFrame plans."""
