"""Market-panel analytics expressed as Spark DataFrame jobs."""
