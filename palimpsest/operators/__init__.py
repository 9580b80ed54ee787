"""Operators: functions from columns to columns, or from DataFrames to DataFrames."""
