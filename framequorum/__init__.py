"""Multi-frame recognition analytics on Spark."""
