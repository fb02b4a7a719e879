"""Licence-package billing analytics on Spark: DataFrames in, DataFrames out."""

from leasebook.model import BASE_ITEM_ID, BillingTables, SoftTables
from leasebook.session import build_session, tune_session

__all__ = ["BASE_ITEM_ID", "BillingTables", "SoftTables", "build_session", "tune_session"]
