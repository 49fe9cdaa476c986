"""Regression of the centre's value from its graph: attention features, a fitted head, checkpoints."""
