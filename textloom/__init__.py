"""Text and document analytics on Apache Spark."""
