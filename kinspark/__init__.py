"""Association scans and corpus preparation on Spark."""
