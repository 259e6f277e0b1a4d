"""A PySpark engine for evaluation analytics, dataset curation and training-data pipelines."""
