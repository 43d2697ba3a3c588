"""quarrymill.operators."""
