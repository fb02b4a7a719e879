"""Row sources several reports use: named clients, named partners, the base item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.functions.joins import lookup_join
from leasebook.functions.text import is_blank, where_text


def with_client(rows: DataFrame, client: DataFrame, columns: list[str], text: str | None = "",
                spread_by: list[str] | None = None) -> DataFrame:
    """Add client columns by ClientID; a search text keeps only matching clients."""
    dim = where_text(client, "ClientName", text).select("ClientID", *columns)
    how = "left" if is_blank(text) else "inner"
    return lookup_join(rows, dim, ["ClientID"], spread_by or ["PackageID"], how)


def named_partners(partner: DataFrame, client: DataFrame, text: str | None = "",
                   keep: list[str] | None = None) -> DataFrame:
    """Package partners with the partner's name; a search text keeps only matching partners."""
    dim = where_text(client, "ClientName", text).select(
        F.col("ClientID").alias("ClientPartnerID"), F.col("ClientName").alias("ClientPartnerName")
    )
    how = "left" if is_blank(text) else "inner"
    keep = ["PackageID"] if keep is None else keep
    return (
        lookup_join(partner.select("ClientPartnerID", *keep), dim, ["ClientPartnerID"], keep, how)
        .select(*keep, "ClientPartnerName")
    )


def base_item_rows(detail: DataFrame, base_item_id: int, keys: list[str], users: str = "LicensedUsers",
                   price: str = "BasePrice") -> DataFrame:
    """Quantity and price of the base item; filtered before the join, so packages without it stay."""
    return detail.where(F.col("ItemID") == base_item_id).select(
        *keys, F.col("Quantity").alias(users), F.col("Price").alias(price)
    )
