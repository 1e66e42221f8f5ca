"""Public-spending analytics and training-data preparation, expressed as Spark jobs."""
