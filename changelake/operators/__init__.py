"""Operators on change sets, versions, data quality and pipeline metrics."""
