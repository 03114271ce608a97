"""factweave: corpus consensus analytics on Spark."""
