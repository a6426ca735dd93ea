"""Permission-aware search analytics on Spark."""
