"""Text retrieval and code-graph analytics as Spark DataFrame operators."""
