"""noetia streaming."""
