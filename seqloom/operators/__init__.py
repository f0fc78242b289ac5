"""Sequence operators: functions from DataFrames or Seqs to DataFrames, all lazy."""
