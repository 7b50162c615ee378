"""strandloom: sequence features and feature-to-model workflows as Spark jobs."""
