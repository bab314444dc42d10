"""Readers that turn stored tables and directories into DataFrames."""
