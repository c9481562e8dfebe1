"""noetia sources."""
