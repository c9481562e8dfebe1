"""noetia operators."""
