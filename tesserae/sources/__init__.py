"""Sources: synthetic generators, views of the sample tables, and file adapters."""
