"""DataFrame-to-DataFrame operators for daily sales analytics on Spark."""
