"""quarrymill.functions."""
