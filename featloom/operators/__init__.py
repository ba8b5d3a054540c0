"""Operators: functions from DataFrame to DataFrame (or to fitted parameters)."""
