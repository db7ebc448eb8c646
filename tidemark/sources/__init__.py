"""Tables in time chunks, files and generators."""
