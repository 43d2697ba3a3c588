"""quarrymill.sources."""
