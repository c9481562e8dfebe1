"""noetia plans."""
