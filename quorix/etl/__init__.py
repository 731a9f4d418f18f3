"""Feature engineering pipelines."""
