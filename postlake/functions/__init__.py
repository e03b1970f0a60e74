"""Part of postlake: functions."""
