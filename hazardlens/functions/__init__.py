"""Package folder."""
