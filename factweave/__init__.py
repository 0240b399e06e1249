"""Entity and fact analytics on Spark."""
