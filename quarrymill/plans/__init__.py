"""quarrymill.plans."""
