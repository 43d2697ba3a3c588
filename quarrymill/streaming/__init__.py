"""quarrymill.streaming."""
