"""Daily price-bar analytics on Spark."""
