"""veilspark: privacy-aware document analytics expressed as Spark DataFrame plans."""
