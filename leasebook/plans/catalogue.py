"""The registered queries: every operator over whole tables of the star schema."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasebook.functions.dates import parse_year_month, year_month_error
from leasebook.functions.text import yes_no
from leasebook.model import SOFT_COLUMNS
from leasebook.operators import changelog, costs, details, expiring, finder, log_state, lookups, padding, parts, searches, submissions, versions
from leasebook.operators.compare import replace_packages
from leasebook.operators.finder import FinderSearch
from leasebook.plans.save import SaveBatch, SoftSaveBatch
from leasebook.plans.sql_reports import register_reports
from leasebook.sources.documents import ROW_TAG, LineFiles
from leasebook.sources.staging import shuffles_removed, staging_root
from leasebook.sources.star_views import StarSource

AS_OF = dt.date(2024, 2, 29)
SEARCH = FinderSearch(client_text="customer#_0", location_text="nation", start_from="1995-02", end_to="2003/01",
                      history="yes", inactive="no", as_of=AS_OF)
EVERYTHING = FinderSearch(history="Yes", inactive="1", as_of=AS_OF)

Query = Callable[[StarSource], DataFrame]
QUERIES: dict[str, Query] = {}

# One XML document per package line, with well-formed, malformed, badly typed and empty cases.
XML_DOCUMENTS = """
SELECT PackageID * 1000000 + detail.ItemID AS submission_id,
  CASE WHEN Discount = 0.1 THEN concat('<Root><r><Row>1</Row><ItemName>', ItemName)
    WHEN Discount = 0 THEN '<Root></Root>'
    ELSE concat('<Root><r><Row>1</Row><ItemName>', ItemName, '</ItemName><ItemPrice>', coalesce(CAST(Price AS STRING), ''),
      '</ItemPrice><Quantity>', CASE WHEN LicenseFactor = 0.08 THEN 'ten' ELSE coalesce(CAST(Quantity AS STRING), '') END,
      '</Quantity><ItemDiscount>', CAST(Discount AS STRING), '</ItemDiscount><LicenseFactor></LicenseFactor></r>',
      CASE WHEN LicenseFactor = 0 THEN '<r><Row>2</Row><ItemName>setup &amp; training</ItemName><ItemPrice>95.5</ItemPrice></r>'
        ELSE '' END, '</Root>') END AS LinesXml
FROM detail JOIN item ON detail.ItemID = item.ItemID"""


# Every package's submission with one document: its lines, cut off for some, with an unreadable value for others.
DOCUMENT_BATCH = """
SELECT s.*, concat('<Root>', coalesce(d.Rows, ''), CASE WHEN s.submission_id % 7 = 3 THEN '<r><Row>' ELSE '</Root>' END) AS LinesXml
FROM submissions s LEFT JOIN (
  SELECT submission_id, concat_ws('', array_sort(collect_list(concat('<r><Row>', CAST(RowNo AS STRING), '</Row><ItemName>', ItemName,
    '</ItemName><ItemPrice>', coalesce(CAST(ItemPrice AS STRING), ''), '</ItemPrice><Quantity>',
    CASE WHEN submission_id % 11 = 5 THEN 'ten' ELSE CAST(Quantity AS STRING) END, '</Quantity><ItemDiscount>',
    CAST(ItemDiscount AS STRING), '</ItemDiscount><LicenseFactor>', CAST(LicenseFactor AS STRING), '</LicenseFactor></r>')))) AS Rows
  FROM submission_lines GROUP BY submission_id) d ON s.submission_id = d.submission_id"""


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _register(name: str, fn: Query) -> None:
    QUERIES[name] = fn


def _batch(s: StarSource, once: bool = True, **options) -> SaveBatch:
    """A batch that is asked for one output, unless `once` is false."""
    return SaveBatch(s.tables(), s.view("submissions"), s.view("submission_lines"), AS_OF, once=once, **options)


def _soft_batch(s: StarSource, once: bool = True) -> SoftSaveBatch:
    return SoftSaveBatch(s.view("client"), s.view("item"), s.soft_tables(), s.view("submissions"),
                         s.view("submission_lines"), AS_OF, once=once)


# Reports

@query
def renewal_cost(s):
    t = s.tables()
    return costs.renewal_cost(t.detail, t.header)


@query
def renewal_cost_exact(s):
    t = s.tables()
    return costs.renewal_cost_exact(t.detail, t.header)


@query
def expiring_finder(s):
    return expiring.expiring_finder(s.tables())


@query
def expiring_finder_search(s):
    return expiring.expiring_finder(s.tables(), "1995/06", "2001-12", "customer", "er#0")


@query
def expiring_packages_sql(s):
    """`expiring_finder_search`, called from SQL."""
    register_reports(s.spark, s.tables())
    return s.spark.sql("SELECT * FROM expiring_packages('1995/06', '2001-12', 'customer', partner_text => 'er#0')")


@query
def expiring_clients_sql(s):
    """`expiring_client_info`, called from SQL."""
    register_reports(s.spark, s.tables())
    return s.spark.sql("SELECT * FROM expiring_clients('1995-01', '2003-12')")


@query
def expiring_client_info(s):
    return expiring.expiring_client_info(s.tables(), "1995-01", "2003-12")


@query
def expiring_package_info(s):
    return expiring.expiring_package_info(s.tables(), "1999-01", "1999-12")


@query
def expiring_package_info_partner(s):
    return expiring.expiring_package_info(s.tables(), "1996-01", "2002-12", "customer")


@query
def finder_current(s):
    return finder.finder_current(s.tables(), SEARCH)


@query
def finder_history(s):
    return finder.finder_history(s.tables(), EVERYTHING)


@query
def history_cost(s):
    t = s.tables()
    return costs.history_cost(t.detail_log, t.header_log)


@query
def version_cost(s):
    t = s.tables()
    return costs.version_cost(t.change_log, t.change_items, t.detail_log, t.header_log)


@query
def finder_all(s):
    return finder.finder_all(s.tables(), EVERYTHING)


@query
def finder_all_search(s):
    return finder.finder_all(s.tables(), SEARCH)


@query
def finder_all_version_cost(s):
    return finder.finder_all(s.tables(), EVERYTHING, by_version_cost=True)


@query
def finder_v0(s):
    return finder.finder_v0(s.tables(), EVERYTHING)


for _name in ["viewer_header", "viewer_items", "previous_header", "previous_items", "request_errors",
              "package_line_items"]:
    _register(_name, lambda s, f=getattr(versions, _name): f(s.view("requests"), s.tables()))
for _name in ["active_identity", "active_header", "active_items", "active_header_editing", "active_items_editing",
              "active_items_v0"]:
    _register(_name, lambda s, f=getattr(versions, _name): f(s.view("renewal_requests"), s.tables()))


@query
def active_header_v0(s):
    return versions.active_header_v0(s.view("renewal_requests"), s.tables(), AS_OF)


@query
def renewal_item_price(s):
    return costs.item_price_modes(s.view("detail"))


@query
def inventory_search(s):
    return lookups.inventory_search(s.view("item"), s.view("item_log"))


@query
def inventory_search_text(s):
    return lookups.inventory_search(s.view("item"), s.view("item_log"), "IN")


@query
def client_lookup(s):
    return lookups.client_lookup(s.view("client"), "#0000")


@query
def partner_lookup(s):
    return lookups.partner_lookup(s.view("client"))


@query
def lookup_many(s):
    return searches.lookup_many(s.view("client"), "ClientName", s.view("name_searches"))


@query
def expiring_finder_many(s):
    return searches.expiring_finder_many(s.tables(), s.view("expiring_searches"))


@query
def search_errors(s):
    return searches.search_errors(s.view("expiring_searches"))


@query
def item_lookup(s):
    return lookups.item_lookup(s.view("item"), "[rs]%g")


@query
def location_lookup(s):
    return lookups.location_lookup(s.view("header_log"), s.view("client"), s.view("client"), "_1")


@query
def pad_blank_rows(s):
    requests = s.view("requests")
    rows = versions.package_line_items(requests, s.tables())
    return padding.pad_blank_rows(rows, requests.select("request_id"))


@query
def pad_empty_text_rows(s):
    requests = s.view("requests")
    rows = versions.package_line_items(requests, s.tables())
    return padding.pad_empty_text_rows(rows, requests.select("request_id"))


@query
def end_of_list_rows(s):
    return padding.end_of_list_rows(s.view("requests").select("request_id"))


@query
def year_month_check(s):
    """The year-month rules over a text made from every order date."""
    texts = s.query("""SELECT o_orderkey, CASE o_orderpriority
        WHEN '1-URGENT' THEN substring(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7)
        WHEN '2-HIGH' THEN replace(substring(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7), '-', '/')
        WHEN '3-MEDIUM' THEN replace(substring(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7), '-', '.')
        WHEN '5-LOW' THEN concat('2020/', substring(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 9, 2))
        ELSE ' ' END AS YearMonth FROM orders""")
    month = F.col("YearMonth")
    return texts.select("o_orderkey", "YearMonth", parse_year_month(month).alias("MonthStart"),
                        year_month_error(month).cast("int").alias("InError"))


@query
def yes_no_check(s):
    return s.view("renewal_requests").select(
        "request_id", *[yes_no(F.col(c)).cast("int").alias(c)
                        for c in ("AutofillHeader", "AutofillItems", "EditingMode")])


# Changes: reading and checking a batch

def _final_packages(s: StarSource) -> DataFrame:
    ids = submissions.assign_package_ids(s.view("submissions"), s.view("header"))
    return ids.select("submission_id", F.col("FinalPackageID").alias("PackageID"))


@query
def parse_lines(s):
    return submissions.parse_lines(s.query(XML_DOCUMENTS))


@query
def parse_errors(s):
    return submissions.parse_errors(s.query(XML_DOCUMENTS))


@query
def parse_files(s):
    """Every line that has a price and a quantity, written as compressed XML documents and read back."""
    folder = f"{staging_root(s.spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    lines = s.query("""SELECT CAST(detail.ItemID AS INT) AS Row, ItemName, Price AS ItemPrice, Quantity, Discount AS ItemDiscount, LicenseFactor
        FROM detail JOIN item ON detail.ItemID = item.ItemID WHERE Price IS NOT NULL AND Quantity IS NOT NULL""")
    with shuffles_removed(s.spark):
        lines.write.format("xml").option("rootTag", submissions.DOCUMENT_TAG).option("rowTag", ROW_TAG).option("compression", "gzip").save(folder)
    return LineFiles(s.spark, folder).lines().drop("File")


@query
def assign_package_ids(s):
    rows = submissions.assign_package_ids(s.view("submissions"), s.view("header"))
    return rows.select("submission_id", "FinalPackageID", F.col("IsNew").cast("int").alias("IsNew"))


@query
def next_package_change_id(s):
    final = _final_packages(s)
    return changelog.next_package_change_id(final, s.view("change_log"))


@query
def resolve_items(s):
    t = s.tables()
    lines = submissions.resolve_items(s.view("submission_lines"), t.item)
    return submissions.last_item_changes(lines, _final_packages(s), t.detail).select(
        "submission_id", "RowNo", "ItemName", "ItemID", "LastDetailItemChangeID")


@query
def validate_header(s):
    return submissions.validate_header(s.view("submissions"), s.view("client")).select(
        "submission_id", "ClientID", "ClientPartnerID", "HeaderError")


@query
def validate_lines(s):
    lines = submissions.resolve_items(s.view("submission_lines"), s.view("item"))
    return submissions.validate_lines(lines).select("submission_id", "RowNo", "ItemID", "LineErrors")


@query
def submission_errors(s):
    return _batch(s).refused


# Changes: first schema

@query
def save_from_documents(s):
    """Refused submissions and line changes of a batch whose lines come as documents."""
    b = SaveBatch(s.tables(), s.query(DOCUMENT_BATCH), None, AS_OF, once=True)
    refused = b.refused.select("submission_id", F.lit(None).cast("long").alias("PackageID"), F.lit(None).cast("long").alias("ItemID"),
                               F.col("ErrorText").alias("Outcome"))
    return refused.unionByName(b.detail_diff.select(F.lit(None).cast("long").alias("submission_id"), "PackageID",
                                                    F.col("ItemID").cast("long").alias("ItemID"), F.col("Action").alias("Outcome")))


@query
def diff_details(s):
    return _batch(s).detail_diff


@query
def details_changed(s):
    return details.details_changed(_batch(s).packages).select(
        "PackageID", F.col("DetailsChanged").cast("int").alias("DetailsChanged"))


@query
def apply_details(s):
    b = _batch(s)
    return _replace(b, "detail", details.detail_rows(b.line_actions, continue_ids=False))


@query
def fix_readded_item_ids(s):
    return _batch(s).new_table("detail")


def _replace(batch, name, rows):
    return replace_packages(getattr(batch.tables, name), batch.accepted, rows)


for _name in ["detail_log_rows", "change_items_rows", "header_log_rows", "partner_log_rows", "note_log_rows",
              "change_log_rows", "row_messages"]:
    _register(_name, lambda s, n=_name: getattr(_batch(s), n))
for _name in ["header", "partner", "note"]:
    _register(f"apply_{_name}", lambda s, n=_name: _batch(s).new_table(n))


@query
def change_items_rows_post(s):
    return _batch(s, post_image=True).change_items_rows


@query
def save_measures(s):
    return _batch(s).measures


@query
def dry_run(s):
    return _batch(s, once=False).dry_run()


# Changes: second schema

for _name in ["header", "detail", "partner", "note"]:
    _register(f"apply_{_name}_soft", lambda s, n=_name: _soft_batch(s).new_table(n))
    _register(f"{_name}_log_rows_soft", lambda s, n=_name: _soft_batch(s).log_rows[f"{n}_log"])
QUERIES["apply_details_soft"] = QUERIES.pop("apply_detail_soft")
QUERIES["detail_log_rows_post"] = QUERIES.pop("detail_log_rows_soft")


@query
def change_log_rows_soft(s):
    return _soft_batch(s).change_log_rows


@query
def dry_run_soft(s):
    return _soft_batch(s, once=False).dry_run()


@query
def state_from_logs(s):
    """Current tables after a batch, from the logs and the batch's log rows."""
    t, b = s.soft_tables(), _soft_batch(s, once=False)
    return log_state.state_from_logs({
        n: getattr(t, n).select(*SOFT_COLUMNS[n]).unionByName(rows.select(*SOFT_COLUMNS[n])) for n, rows in b.log_rows.items()})


@query
def log_drift(s):
    """Lines whose log does not give their current row."""
    t = s.soft_tables()
    return log_state.drift(t.detail, t.detail_log, "detail")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](StarSource(spark, sf_dir))
