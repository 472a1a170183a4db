"""Expressions: reductions as aggregate columns (``columns``) and inside array rows (``arrays``)."""
