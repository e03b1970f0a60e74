"""Part of postlake: plans."""
