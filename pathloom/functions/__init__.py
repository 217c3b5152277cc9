"""Part of pathloom: functions."""
