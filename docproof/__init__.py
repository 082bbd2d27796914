"""Invoice-document quality and analytics as Spark DataFrame jobs."""
