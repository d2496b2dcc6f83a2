"""Network-flow security analytics expressed as Spark DataFrame operators."""
