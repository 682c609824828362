"""Content-protection analytics as Spark DataFrame and Structured Streaming operators."""
