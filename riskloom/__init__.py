"""Country-day risk analytics on Spark."""
