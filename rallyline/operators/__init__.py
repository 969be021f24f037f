"""Operators over ordered event streams: DataFrame in, DataFrame out."""
