"""Part of postlake: operators."""
