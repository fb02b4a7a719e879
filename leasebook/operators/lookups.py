"""Catalogue search and the lookup lists of the forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.functions.text import text_key, where_text


def inventory_search(item: DataFrame, item_log: DataFrame, item_text: str = "") -> DataFrame:
    """Catalogue items with the time of their last change."""
    return (
        where_text(item, "ItemName", item_text)
        .join(item_log.select("ItemChangeID", "Updated"), "ItemChangeID", "left")
        .select("ItemID", "ItemName", "DefaultPrice", "Updated")
    )


def client_lookup(client: DataFrame, text: str = "") -> DataFrame:
    return where_text(client, "ClientName", text).select("ClientName")


def partner_lookup(client: DataFrame, text: str = "") -> DataFrame:
    return client_lookup(client, text).withColumnRenamed("ClientName", "ClientPartnerName")


def item_lookup(item: DataFrame, text: str = "") -> DataFrame:
    return where_text(item, "ItemName", text).select("ItemName")


def location_lookup(header_log: DataFrame, client: DataFrame, names: DataFrame, text: str = "") -> DataFrame:
    """Distinct logged locations of each client named in `names[ClientName]`.

    Locations are made distinct per ClientID before the names join, so a client with very
    many versions reaches the join as its few locations.
    """
    places = where_text(header_log, "Location", text).select("ClientID", "Location").distinct()
    wanted = names.select("ClientName", text_key(F.col("ClientName")).alias("_name")).distinct()
    ids = client.select("ClientID", text_key(F.col("ClientName")).alias("_name"))
    return (
        ids.join(wanted, "_name").join(places, "ClientID").select("ClientName", "Location").distinct()
    )
