"""Configuration, pipelines and models."""
