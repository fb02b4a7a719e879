"""Reading and checking a batch of submitted packages.

A batch is two tables: `submissions`, one row per package, and its lines, keyed by
`submission_id`. Nothing here depends on how many submissions a batch holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.functions.joins import lookup_join
from leasebook.functions.numbering import number_rows
from leasebook.functions.text import text_key
from leasebook.model import MONEY, RATE
from leasebook.sources.staging import stage

# Element names of the line document and the notices for the user.
DOCUMENT_TAG = "Root"
LINE_FIELDS = {"Row": "int", "ItemName": "string", "ItemPrice": MONEY, "Quantity": "int",
               "ItemDiscount": RATE, "LicenseFactor": RATE}
BAD_DOCUMENT = "Error in parsing XML: the document is malformed"
BAD_VALUE = "Error in parsing XML: a value could not be converted"
UNKNOWN_CLIENT = (" ClientName entered does not match any entries in the database. Please only enter client names"
                  " from the dropdown list.")
UNKNOWN_PARTNER = (" ClientPartnerName entered does not match any entries in the database. Please only enter client"
                   " partner names from the dropdown list.")
REPEATED_PACKAGE = "The package occurs more than once in this batch."
NO_SUBMISSION_ID = "The submission has no id."
REPEATED_SUBMISSION_ID = "The id of the submission occurs more than once in this batch."
BAD_LINES = "There were errors in the details of your input.  Please review the errors noted in each row."
DUPLICATE_ITEM = ", Duplicate key (two or more entries of the same item is forbidden)"
UNKNOWN_ITEM = (", Item entered was not found in the database: please check the Inventory report and only enter items"
                " which exist there")
BLANK_PRICE = ", Price should not be left blank"
BLANK_QUANTITY = ", Quantity should not be left blank"


def unreadable_line(line: Column) -> Column:
    """Whether a line of texts holds a value that cannot be converted."""
    bad = F.lit(False)
    for name, kind in LINE_FIELDS.items():
        if kind != "string":
            value = F.trim(line[name])
            bad = bad | (F.coalesce(F.length(value) > 0, F.lit(False)) & value.try_cast(kind).isNull())
    return bad


def typed_line(line: str) -> list[Column]:
    """The fields of a column of texts with their types and names."""
    values = {n: F.col(f"{line}.{n}") for n in LINE_FIELDS}
    return [(values[n] if k == "string" else F.trim(values[n]).try_cast(k)).alias("RowNo" if n == "Row" else n)
            for n, k in LINE_FIELDS.items()]


def parsed_documents(submissions: DataFrame) -> DataFrame:
    """`submissions[submission_id, LinesXml]` with the lines of each document and, if it could not be read, the reason."""
    fields = ", ".join(f"{name}: string" for name in LINE_FIELDS)
    options = {"rowTag": DOCUMENT_TAG, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
               "ignoreSurroundingSpaces": "false"}
    document = F.from_xml("LinesXml", f"r array<struct<{fields}>>, _corrupt string", options)
    filled = F.length(F.col("LinesXml")) > 0
    # Exploding a one-element array keeps later filters from being moved below the parser,
    # which would parse every document once per reference.
    parsed = submissions.select("submission_id", F.explode(F.array(F.when(filled, document))).alias("_doc"))

    bad_value = F.coalesce(F.exists("_doc.r", unreadable_line), F.lit(False))
    error = F.when(F.col("_doc._corrupt").isNotNull(), BAD_DOCUMENT).when(bad_value, BAD_VALUE)
    return parsed.select("submission_id", F.col("_doc.r").alias("_lines"), error.alias("ParseError"))


def lines_of(parsed: DataFrame) -> DataFrame:
    """Lines of parsed documents; one with an error anywhere gives none."""
    lines = parsed.where("ParseError IS NULL").select("submission_id", F.explode("_lines").alias("_line"))
    return lines.select("submission_id", *typed_line("_line"))


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("ParseError IS NOT NULL").select("submission_id", "ParseError")


def parse_lines(submissions: DataFrame) -> DataFrame:
    """Lines of the XML documents in `submissions[submission_id, LinesXml]`.

    A document with an error anywhere gives no lines; see `parse_errors`.
    """
    return lines_of(parsed_documents(submissions))


def parse_errors(submissions: DataFrame) -> DataFrame:
    """Submissions whose document could not be read, with the reason."""
    return errors_of(parsed_documents(submissions))


def _ids_by_name(table: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """One id per name; the lowest where a name is not unique."""
    return table.groupBy(text_key(F.col(name_column)).alias("_name")).agg(F.min(id_column).alias(id_column))


def mark_new_packages(submissions: DataFrame, header: DataFrame) -> DataFrame:
    """Add IsNew: the package id is 0 or belongs to no package."""
    known = header.select("PackageID", F.lit(True).alias("_known"))
    is_new = F.col("_known").isNull() | (F.col("PackageID") == 0)
    return submissions.join(known, "PackageID", "left").withColumn("IsNew", is_new).drop("_known")


def number_new_packages(marked: DataFrame, header: DataFrame, highest: int | None = None) -> DataFrame:
    """Add FinalPackageID: known packages keep their id, new ones continue after the highest.

    New packages are numbered in the order of submission_id. `highest` is for a `header` that holds
    a part of all packages only.
    """
    kept = marked.where("NOT IsNew").withColumn("FinalPackageID", F.col("PackageID"))
    fresh = number_rows(marked.where("IsNew"), "submission_id", "_number")
    after = header.agg(F.coalesce(F.max("PackageID"), F.lit(0))).scalar() if highest is None else F.lit(highest).cast("long")
    return kept.unionByName(fresh.withColumn("FinalPackageID", after + F.col("_number")).drop("_number"))


def assign_package_ids(submissions: DataFrame, header: DataFrame) -> DataFrame:
    """Add IsNew and FinalPackageID."""
    return number_new_packages(mark_new_packages(submissions, header), header)


def resolve_items(lines: DataFrame, item: DataFrame) -> DataFrame:
    """Add ItemID, found by item name; NULL where no item has the name."""
    named = lines.withColumn("_name", text_key(F.col("ItemName")))
    ids = _ids_by_name(item, "ItemID", "ItemName")
    return lookup_join(named, ids, ["_name"], ["submission_id", "RowNo"]).drop("_name")


def last_item_changes(lines: DataFrame, packages: DataFrame, detail: DataFrame) -> DataFrame:
    """Add PackageID and the item's current change id in that package to resolved lines."""
    current = detail.select("PackageID", "ItemID", F.col("DetailItemChangeID").alias("LastDetailItemChangeID"))
    return lines.join(packages.select("submission_id", "PackageID"), "submission_id").join(
        current, ["PackageID", "ItemID"], "left"
    )


def validate_header(submissions: DataFrame, client: DataFrame) -> DataFrame:
    """Add ClientID, ClientPartnerID and HeaderError. A blank partner is no partner."""
    ids = _ids_by_name(client, "ClientID", "ClientName")
    partner_ids = ids.select(F.col("_name").alias("_partner"), F.col("ClientID").alias("ClientPartnerID"))
    has_partner = F.coalesce(F.length(F.rtrim("ClientPartnerName")) > 0, F.lit(False))
    keyed = submissions.withColumn("_name", text_key(F.col("ClientName"))).withColumn(
        "_partner", F.when(has_partner, text_key(F.col("ClientPartnerName")))
    )
    found = lookup_join(keyed, ids, ["_name"], ["submission_id"])
    found = lookup_join(found, partner_ids, ["_partner"], ["submission_id"])
    error = F.when(F.col("ClientID").isNull(), UNKNOWN_CLIENT).when(
        F.col("_partner").isNotNull() & F.col("ClientPartnerID").isNull(), UNKNOWN_PARTNER
    )
    return found.withColumn("HeaderError", error).drop("_name", "_partner")


def validate_lines(resolved: DataFrame) -> DataFrame:
    """Add LineErrors to lines with an ItemID: every notice that applies, in a fixed order.

    Repeated items are counted per (submission, item) and joined back, so the lines of a
    very large submission are never brought together in one task. They are written first: Spark
    then knows how few they are and need not shuffle the lines to meet them.
    """
    repeated = stage(
        resolved.where("ItemID IS NOT NULL").groupBy("submission_id", "ItemID")
        .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("submission_id", "ItemID")
    ).withColumn("_repeated", F.lit(True))

    def notice(condition: Column, text: str) -> Column:
        return F.when(condition, text).otherwise("")

    price, quantity = F.col("ItemPrice"), F.col("Quantity")
    errors = F.concat(
        notice(F.col("_repeated").isNotNull(), DUPLICATE_ITEM), notice(F.col("ItemID").isNull(), UNKNOWN_ITEM),
        notice(price.isNull() | (price == 0), BLANK_PRICE), notice(quantity.isNull() | (quantity == 0), BLANK_QUANTITY),
    )
    return (
        resolved.join(repeated, ["submission_id", "ItemID"], "left")
        .withColumn("LineErrors", errors).drop("_repeated")
    )


def submission_errors(checked: DataFrame, checked_lines: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """Add ErrorText to submissions checked by `validate_header`; NULL means accepted.

    The first problem counts: the submission's own id, an unreadable document (`unread`, the rows of
    `parse_errors`), client or partner, a package occurring twice, lines.
    """
    def again(key: str) -> DataFrame:
        return checked.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.lit(key).alias("_of"), F.col(key).alias("_id"))

    bad_lines = checked_lines.where("LineErrors <> ''").select(F.lit("lines").alias("_of"), F.col("submission_id").alias("_id")).distinct()
    # Written first, so that Spark knows how few they are; joins by submission come before the one by package.
    problems = stage(again("submission_id").unionByName(again("PackageID").where("_id <> 0")).unionByName(bad_lines)).where("_id IS NOT NULL")

    def marked(of: str, key: str, mark: str) -> DataFrame:
        return problems.where(F.col("_of") == of).select(F.col("_id").alias(key), F.lit(True).alias(mark))

    unread = checked.select("submission_id", F.lit(None).cast("string").alias("ParseError")).where("false") if unread is None else unread
    error = (
        F.when(F.col("submission_id").isNull(), NO_SUBMISSION_ID).when(F.col("_again"), REPEATED_SUBMISSION_ID)
        .when(F.col("ParseError").isNotNull(), F.col("ParseError"))
        .when(F.col("HeaderError").isNotNull(), F.col("HeaderError"))
        .when(F.col("_repeated"), REPEATED_PACKAGE).when(F.col("_bad_lines"), BAD_LINES)
    )
    return (
        checked.join(unread.dropDuplicates(["submission_id"]), "submission_id", "left")
        .join(marked("submission_id", "submission_id", "_again"), "submission_id", "left")
        .join(marked("lines", "submission_id", "_bad_lines"), "submission_id", "left")
        .join(marked("PackageID", "PackageID", "_repeated"), "PackageID", "left")
        .withColumn("ErrorText", error).drop("_repeated", "_bad_lines", "_again", "ParseError", "HeaderError")
    )
