"""noetia functions."""
