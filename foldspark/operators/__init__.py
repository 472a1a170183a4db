"""Reductions of DataFrames (``frame``), eager values (``eager``), and the trusted names (``trusted``)."""
