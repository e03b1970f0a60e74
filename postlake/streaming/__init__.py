"""Part of postlake: streaming."""
