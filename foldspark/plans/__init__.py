"""Sizing of plans: work per task (``config``) and its tuning (``tuning``)."""
