"""The two pipelines."""
