"""Dataset operators: functions from DataFrames to DataFrames."""
