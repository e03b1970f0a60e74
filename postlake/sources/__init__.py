"""Part of postlake: sources."""
