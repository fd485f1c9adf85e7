"""Space-time grid and rare-event analytics as PySpark DataFrame operators."""
