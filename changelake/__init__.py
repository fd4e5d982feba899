"""Analytics-ready copies of operational tables, kept by change events, on PySpark."""

from changelake.lake import ChangeTable, Lake, VersionExpired

__all__ = ["ChangeTable", "Lake", "VersionExpired"]
