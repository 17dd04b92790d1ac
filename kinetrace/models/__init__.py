"""Training and scoring of models."""
