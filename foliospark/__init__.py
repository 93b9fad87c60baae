"""foliospark: regulatory-text analytics expressed as lazy Spark DataFrame operators."""
