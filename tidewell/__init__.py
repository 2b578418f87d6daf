"""Tidewell: hybrid retrieval and conversation analytics as Spark DataFrame jobs."""
