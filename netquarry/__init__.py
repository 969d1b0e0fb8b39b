"""Analytics over mobile-network operations data as Spark DataFrames."""

from netquarry.session import build_session, prepare, work_folder

__all__ = ["build_session", "prepare", "work_folder"]
