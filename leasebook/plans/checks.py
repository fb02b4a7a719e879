"""Plain SQL statements of the registered queries, for checking them on another engine.

They follow the rules as stated, row by row, and share nothing with the operators but the
views of the billing tables.
"""

from __future__ import annotations

from leasebook.sources.star_views import with_views

AS_OF = "DATE '2024-02-29'"


def months(a: str, b: str) -> str:
    return f"CAST(date_diff('month', {a}, {b}) AS INT)"


def unit(p: str = "Price", d: str = "Discount", f: str = "LicenseFactor") -> str:
    return f"CAST(({p} + {p} * {f}) * CAST(1 - {d} AS DECIMAL(6,4)) AS DECIMAL(23,8))"


AMOUNT = f"CAST(sum(CAST(CAST(Quantity AS DECIMAL(10,0)) * {unit()} AS DECIMAL(26,8))) AS DECIMAL(26,8))"
TERM = months("LicenseStartDate", "LicenseExpirationDate")


def cost(term: str, amount: str, discount: str | None) -> str:
    rest = f" * CAST(1 - {discount} AS DECIMAL(6,4))" if discount else ""
    return f"CAST(CAST({amount} * CAST({term} AS DECIMAL(6,0)) AS DECIMAL(31,8)){rest} AS DECIMAL(28,4))"


V: dict[str, str] = {}  # shared subqueries

V["c_cost"] = f"""
SELECT h.PackageID, {cost(TERM, AMOUNT, 'PackageDiscount')} AS Cost
FROM detail d LEFT JOIN header h ON d.PackageID = h.PackageID
GROUP BY h.PackageID, LicenseStartDate, LicenseExpirationDate, PackageDiscount"""

V["c_history_cost"] = f"""
SELECT h.PackageID, LicenseStartDate, LicenseExpirationDate, PackageDiscount,
  {cost(TERM, AMOUNT, 'PackageDiscount')} AS TotalPackageCost
FROM detail_log d LEFT JOIN header_log h ON d.PackageID = h.PackageID
GROUP BY h.PackageID, LicenseStartDate, LicenseExpirationDate, PackageDiscount"""

V["c_history_cost_v0"] = f"""
SELECT h.PackageID, {cost(months('max(LicenseStartDate)', 'max(LicenseExpirationDate)'), AMOUNT, None)} AS TotalPackageCost
FROM detail_log d LEFT JOIN header_log h ON d.PackageID = h.PackageID GROUP BY h.PackageID"""

V["c_version_cost"] = f"""
SELECT v.PackageID, v.ChangeID, {cost(TERM, AMOUNT, 'PackageDiscount')} AS TotalPackageCost
FROM change_log v JOIN header_log h ON v.PackageID = h.PackageID AND v.HeaderChangeID = h.HeaderChangeID
  JOIN change_items m ON m.LicensePackageID = v.PackageID AND m.LicensePackageChangeID = v.ChangeID
  JOIN detail_log d ON d.PackageID = m.LicensePackageID AND d.ItemID = m.ItemID
    AND d.DetailGroupChangeID = m.LatestDetailGroupChangeID
GROUP BY v.PackageID, v.ChangeID, LicenseStartDate, LicenseExpirationDate, PackageDiscount"""

C: dict[str, str] = {}  # one statement per query


# Expiring packages

C["renewal_cost_exact"] = f"""
SELECT h.PackageID, CAST(CAST(q.Monthly AS DECIMAL(26,6)) * CAST({TERM} AS DECIMAL(6,0)) * CAST(1 - PackageDiscount AS DECIMAL(6,4))
  AS DECIMAL(38,6)) AS CalculatedRenewalCost
FROM header h JOIN (SELECT PackageID, sum(CAST(Quantity AS DECIMAL(10,0)) * CAST((Price + Price * LicenseFactor)
    * CAST(1 - Discount AS DECIMAL(6,4)) AS DECIMAL(25,6))) AS Monthly
  FROM detail GROUP BY PackageID) q ON h.PackageID = q.PackageID"""
C["renewal_cost"] = "SELECT PackageID, Cost AS CalculatedRenewalCost FROM c_cost"


def _expiring(where: str) -> str:
    return f"""
SELECT c.ClientName, cp.ClientName AS ClientPartnerName, h.Location, c.BillingContactName, c.BillingEmail, h.PackageID,
  coalesce(b.Quantity, 0) AS LicensedUsers, h.UserMinimum, b.Price AS BasePrice, h.LicenseStartDate,
  h.LicenseExpirationDate, {TERM} AS DurationMonths,
  coalesce(r.Cost, CAST(0 AS DECIMAL(28,4))) AS CalculatedRenewalCost
FROM header h LEFT JOIN client c ON h.ClientID = c.ClientID LEFT JOIN partner p ON h.PackageID = p.PackageID
  LEFT JOIN client cp ON p.ClientPartnerID = cp.ClientID
  LEFT JOIN detail b ON h.PackageID = b.PackageID AND b.ItemID = 5 LEFT JOIN c_cost r ON h.PackageID = r.PackageID
WHERE {where}"""


C["expiring_finder"] = _expiring("true")
C["expiring_finder_search"] = _expiring(
    "h.LicenseExpirationDate BETWEEN DATE '1995-06-01' AND DATE '2001-12-01' AND lower(c.ClientName) LIKE '%customer%'"
    " AND lower(cp.ClientName) LIKE '%er#0%'")
C["expiring_client_info"] = """
SELECT CAST(h.ClientID AS VARCHAR) || '-' || h.Location AS ClientLocationKey, c.ClientName,
  cp.ClientName AS ClientPartnerName, h.Location, c.BillingContactName, c.BillingEmail
FROM header h LEFT JOIN client c ON h.ClientID = c.ClientID LEFT JOIN partner p ON h.PackageID = p.PackageID
  LEFT JOIN client cp ON p.ClientPartnerID = cp.ClientID
WHERE h.LicenseExpirationDate BETWEEN DATE '1995-01-01' AND DATE '2003-12-01'
GROUP BY h.ClientID, h.Location, c.ClientName, cp.ClientName, c.BillingContactName, c.BillingEmail,
  h.LicenseExpirationDate"""


C["expiring_packages_sql"] = C["expiring_finder_search"]
C["expiring_clients_sql"] = C["expiring_client_info"]


def _package_info(where: str) -> str:
    return f"""
SELECT CAST(h.ClientID AS VARCHAR) || '-' || h.Location AS ClientLocationKey, h.PackageID,
  coalesce(b.Quantity, 0) AS LicensedUsers, h.UserMinimum, b.Price AS BasePrice, h.LicenseStartDate,
  h.LicenseExpirationDate, {TERM} AS DurationMonths,
  coalesce(r.Cost, CAST(0 AS DECIMAL(28,4))) AS CalculatedRenewalCost
FROM header h LEFT JOIN detail b ON h.PackageID = b.PackageID AND b.ItemID = 5
  LEFT JOIN c_cost r ON h.PackageID = r.PackageID LEFT JOIN partner p ON h.PackageID = p.PackageID
  LEFT JOIN client cp ON p.ClientPartnerID = cp.ClientID
WHERE {where}"""


C["expiring_package_info"] = _package_info("true")
C["expiring_package_info_partner"] = _package_info(
    "h.LicenseExpirationDate BETWEEN DATE '1996-01-01' AND DATE '2002-12-01' AND lower(cp.ClientName) LIKE '%customer%'")

# Finder

SEARCH_WHERE = """lower(h.Location) LIKE '%nation%' AND lower(c.ClientName) LIKE '%customer#_0%'
  AND h.LicenseStartDate >= DATE '1995-02-01' AND h.LicenseExpirationDate <= DATE '2003-01-01' AND h.Inactive = 0"""
OPEN_WHERE = "true"
V0_WHERE = "h.Location LIKE '%' AND c.ClientName LIKE '%'"


def _found(total: str, source: str, change: str, note: str) -> str:
    return f"""SELECT c.ClientName, cp.ClientName AS ClientPartnerName, h.Location, h.PackageID,
  b.Quantity AS LicensedUsers, h.UserMinimum, b.Price AS BasePrice, h.LicenseStartDate, h.LicenseExpirationDate,
  {months('h.LicenseStartDate', 'h.LicenseExpirationDate')} AS DurationMonths, {total} AS TotalPackageCost,
  CASE WHEN h.Inactive = 1 THEN 'Inactive' ELSE 'Active' END AS Status, '{source}' AS FromCacheOrCurrentText,
  {change} AS ChangeID, {note} AS Note"""


def _current(where: str, v0: bool = False) -> str:
    log = "" if v0 else "JOIN change_log v ON h.PackageID = v.PackageID"
    return f"""{_found('r.Cost', 'Current Version', '0' if v0 else 'max(v.ChangeID)', 'n.Note')}
FROM header h {log} LEFT JOIN client c ON h.ClientID = c.ClientID LEFT JOIN partner p ON h.PackageID = p.PackageID
  LEFT JOIN client cp ON p.ClientPartnerID = cp.ClientID
  LEFT JOIN detail b ON h.PackageID = b.PackageID AND b.ItemID = 5 LEFT JOIN note n ON h.PackageID = n.PackageID
  LEFT JOIN c_cost r ON h.PackageID = r.PackageID
WHERE {where}
GROUP BY h.PackageID, c.ClientName, cp.ClientName, h.Location, b.Quantity, h.UserMinimum, b.Price,
  h.LicenseStartDate, h.LicenseExpirationDate, r.Cost, h.Inactive, n.Note"""


def _history(where: str, costs: str = "c_history_cost r ON h.PackageID = r.PackageID") -> str:
    return f"""{_found('r.TotalPackageCost', 'Previous version from cache', 'v.ChangeID', 'n.Note')}
FROM header_log h JOIN change_log v ON h.PackageID = v.PackageID AND h.HeaderChangeID = v.HeaderChangeID
  LEFT JOIN detail_log b ON v.PackageID = b.PackageID AND v.DetailGroupChangeID = b.DetailGroupChangeID AND b.ItemID = 5
  LEFT JOIN client c ON h.ClientID = c.ClientID
  LEFT JOIN partner_log p ON v.PackageID = p.PackageID AND v.ClientPartnerChangeID = p.ClientPartnerChangeID
  LEFT JOIN client cp ON p.ClientPartnerID = cp.ClientID
  LEFT JOIN note_log n ON v.PackageID = n.PackageID AND v.ChangeID = n.LicPackageChangeID
  LEFT JOIN {costs}
WHERE {where}"""


BY_VERSION = "c_version_cost r ON v.PackageID = r.PackageID AND v.ChangeID = r.ChangeID"
C["finder_current"] = _current(SEARCH_WHERE)
C["finder_history"] = f"SELECT DISTINCT * FROM ({_history(OPEN_WHERE, BY_VERSION)}) q"
C["history_cost"] = "SELECT * FROM c_history_cost"
C["version_cost"] = "SELECT * FROM c_version_cost"
C["finder_all"] = C["finder_all_version_cost"] = f"{_current(OPEN_WHERE)} UNION {_history(OPEN_WHERE, BY_VERSION)}"
C["finder_all_search"] = f"{_current(SEARCH_WHERE)} UNION {_history(SEARCH_WHERE, BY_VERSION)}"
C["finder_v0"] = (f"{_current(V0_WHERE, v0=True)} UNION "
                  + _history(f"{V0_WHERE} AND v.ChangeID <> 0", "c_history_cost_v0 r ON h.PackageID = r.PackageID"))

# Requests

V["c_asked"] = """
SELECT q.request_id, q.PackageID, q.ChangeID, h.PackageID IS NOT NULL AS HasPackage, v.PackageID IS NOT NULL AS HasVersion
FROM requests q LEFT JOIN (SELECT DISTINCT PackageID FROM header) h ON q.PackageID = h.PackageID
  LEFT JOIN (SELECT DISTINCT PackageID, ChangeID FROM change_log) v ON q.PackageID = v.PackageID AND q.ChangeID = v.ChangeID"""
V["c_errors"] = """
SELECT request_id, PackageID, ChangeID, HasVersion, CASE
  WHEN NOT HasPackage AND PackageID <> 0 THEN concat('Previous license package ID entered ("', CAST(PackageID AS VARCHAR),
    '") does not exist. Please search for an existing package using the LicensePackageFinder and try again.')
  WHEN NOT HasVersion AND ChangeID <> 0 THEN concat('Previous license package ID entered ("',
    CAST(PackageID AS VARCHAR), '") does not have a history entry #', CAST(ChangeID AS VARCHAR),
    '. Please use the LicensePackageFinder to search for a valid ChangeID for this Package.') END AS ErrorText
FROM c_asked"""
V["c_routed"] = """
SELECT request_id, PackageID, ChangeID, HasVersion AND ChangeID <> 0 AS InHistory FROM c_errors WHERE ErrorText IS NULL"""
C["request_errors"] = "SELECT request_id, PackageID, ChangeID, ErrorText FROM c_errors WHERE ErrorText IS NOT NULL"
V["c_version_parts"] = """
SELECT v.PackageID, v.ChangeID, h.ClientID, p.ClientPartnerID, h.Location, b.Quantity AS LicensedUsers,
  b.Price AS BasePrice, h.UserMinimum, h.PackageDiscount, p.PartnerSplitPercentage, h.LicenseStartDate,
  h.LicenseExpirationDate, n.Note
FROM change_log v LEFT JOIN header_log h ON v.PackageID = h.PackageID AND v.HeaderChangeID = h.HeaderChangeID
  LEFT JOIN detail_log b ON v.PackageID = b.PackageID AND v.DetailGroupChangeID = b.DetailGroupChangeID AND b.ItemID = 5
  LEFT JOIN partner_log p ON v.PackageID = p.PackageID AND v.ClientPartnerChangeID = p.ClientPartnerChangeID
  LEFT JOIN note_log n ON v.PackageID = n.PackageID AND v.ChangeID = n.LicPackageChangeID"""
V["c_current_parts"] = """
SELECT h.PackageID, h.ClientID, p.ClientPartnerID, h.Location, b.Quantity AS LicensedUsers, b.Price AS BasePrice,
  h.UserMinimum, h.PackageDiscount, p.PartnerSplitPercentage, h.LicenseStartDate, h.LicenseExpirationDate, n.Note,
  b.PackageID IS NOT NULL AS HasBase
FROM header h LEFT JOIN detail b ON h.PackageID = b.PackageID AND b.ItemID = 5
  LEFT JOIN partner p ON h.PackageID = p.PackageID LEFT JOIN note n ON h.PackageID = n.PackageID"""


def _viewer(source: str, mail: str, join: str) -> str:
    return f"""SELECT q.request_id, s.LicenseStartDate, s.LicenseExpirationDate, c.ClientName,
  c.BillingAddress1 AS ClientAddress, c.BillingContactName, c.BillingPhoneNumber, {mail} AS BillingEmail,
  {months('s.LicenseStartDate', 's.LicenseExpirationDate')} AS PackageTerm, s.PackageDiscount
FROM c_routed q JOIN {source} s ON {join} LEFT JOIN client c ON s.ClientID = c.ClientID"""


IN_HISTORY = "q.InHistory AND q.PackageID = s.PackageID AND q.ChangeID = s.ChangeID"
NOT_IN_HISTORY = "NOT coalesce(q.InHistory, false) AND q.PackageID = s.PackageID"
C["viewer_header"] = (_viewer("c_version_parts", "NULL", IN_HISTORY) + " UNION ALL "
                      + _viewer("c_current_parts", "c.BillingEmail", NOT_IN_HISTORY))


def _previous(source: str, join: str) -> str:
    return f"""SELECT q.request_id, c.ClientName, cp.ClientName AS ClientPartnerName, s.Location, s.LicensedUsers,
  s.BasePrice, {months('s.LicenseStartDate', 's.LicenseExpirationDate')} AS LicenseTermMonths, s.UserMinimum,
  s.PackageDiscount, s.PartnerSplitPercentage, s.LicenseStartDate, s.LicenseExpirationDate, s.Note
FROM c_routed q JOIN {source} s ON {join} LEFT JOIN client c ON s.ClientID = c.ClientID
  LEFT JOIN client cp ON s.ClientPartnerID = cp.ClientID"""


C["previous_header"] = _previous("c_version_parts", IN_HISTORY) + " UNION ALL " + _previous("c_current_parts", NOT_IN_HISTORY)
LINE_COLUMNS = "i.ItemName, s.Price AS ItemPrice, s.Quantity, s.Discount AS ItemDiscount, s.LicenseFactor"


def _lines(join: str) -> str:
    return f"""
SELECT q.request_id, {LINE_COLUMNS} FROM c_routed q
  JOIN change_items m ON q.PackageID = m.LicensePackageID AND q.ChangeID = m.LicensePackageChangeID AND q.InHistory
  {join} JOIN detail_log s ON m.LicensePackageID = s.PackageID AND m.LatestDetailGroupChangeID = s.DetailGroupChangeID
    AND m.ItemID = s.ItemID
  {join} JOIN item i ON s.ItemID = i.ItemID
UNION ALL
SELECT q.request_id, {LINE_COLUMNS} FROM c_routed q JOIN detail s ON {NOT_IN_HISTORY} {join} JOIN item i ON s.ItemID = i.ItemID"""


C["viewer_items"] = _lines("INNER")
C["previous_items"] = _lines("LEFT")
V["c_package_lines"] = f"""
SELECT q.request_id, {LINE_COLUMNS}
FROM requests q JOIN detail s ON q.PackageID = s.PackageID LEFT JOIN item i ON s.ItemID = i.ItemID"""
C["package_line_items"] = "SELECT * FROM c_package_lines"
C["pad_blank_rows"] = """
SELECT * FROM c_package_lines UNION ALL
SELECT request_id, '', NULL, NULL, NULL, NULL FROM (SELECT request_id, unnest(range(5)) FROM requests) k"""
C["pad_empty_text_rows"] = """
SELECT request_id, ItemName, CAST(ItemPrice AS VARCHAR) AS ItemPrice, CAST(Quantity AS VARCHAR) AS Quantity,
  CAST(ItemDiscount AS VARCHAR) AS ItemDiscount, CAST(LicenseFactor AS VARCHAR) AS LicenseFactor FROM c_package_lines
UNION ALL SELECT request_id, '', '', '', '', '' FROM (SELECT request_id, unnest(range(5)) FROM requests) k"""
C["end_of_list_rows"] = """
SELECT request_id, 'END_OF_LIST' AS EndOfListKey, '' AS ItemName, '' AS ItemPrice, '' AS Quantity, '' AS ItemDiscount,
  '' AS LicenseFactor FROM (SELECT request_id, unnest(range(5)) FROM requests) k"""

C["active_identity"] = """
SELECT q.request_id, c.ClientName, cp.ClientName AS ClientPartnerName, h.Location
FROM renewal_requests q JOIN header h ON q.LicensePackageID = h.PackageID LEFT JOIN client c ON h.ClientID = c.ClientID
  LEFT JOIN partner p ON h.PackageID = p.PackageID LEFT JOIN client cp ON p.ClientPartnerID = cp.ClientID"""
V["c_renewals"] = """
SELECT q.request_id, q.LicensePackageID, q.PrevPackageID, q.PrevChangeID,
  lower(q.AutofillHeader) IN ('yes', 'y', '1') AS FillHeader, lower(q.AutofillItems) IN ('yes', 'y', '1') AS FillItems,
  lower(q.EditingMode) IN ('yes', 'y', '1') AS Editing,
  coalesce(q.PrevChangeID <> 0, false) AND v.PackageID IS NOT NULL AS InHistory
FROM renewal_requests q LEFT JOIN (SELECT DISTINCT PackageID, ChangeID FROM change_log) v
  ON v.PackageID = q.PrevPackageID AND v.ChangeID = q.PrevChangeID"""
HEAD_COLUMNS = "s.LicensedUsers, s.BasePrice, s.UserMinimum, s.PackageDiscount, s.PartnerSplitPercentage"


def _active_header(flag: str) -> str:
    next_day = "CASE WHEN s.LicenseExpirationDate < DATE '9999-12-31' THEN CAST(s.LicenseExpirationDate + INTERVAL 1 DAY AS DATE) END"
    next_end = f"CAST(({next_day}) + to_months({months('s.LicenseStartDate', 's.LicenseExpirationDate')}) AS DATE)"
    renewed = f"""{HEAD_COLUMNS}, {next_day} AS DefaultPackageStartDate,
  CASE WHEN {next_end} <= DATE '9999-12-31' THEN {next_end} END AS DefaultPackageEndDate, s.Note"""
    return f"""
SELECT q.request_id, {HEAD_COLUMNS}, s.LicenseStartDate AS DefaultPackageStartDate,
  s.LicenseExpirationDate AS DefaultPackageEndDate, s.Note
FROM c_renewals q JOIN c_current_parts s ON q.LicensePackageID = s.PackageID WHERE NOT ({flag})
UNION ALL SELECT q.request_id, {renewed}
FROM c_renewals q JOIN c_version_parts s ON q.PrevPackageID = s.PackageID AND q.PrevChangeID = s.ChangeID
WHERE ({flag}) AND q.InHistory
UNION ALL SELECT q.request_id, {renewed}
FROM c_renewals q JOIN c_current_parts s ON q.PrevPackageID = s.PackageID WHERE ({flag}) AND NOT q.InHistory"""


def _active_items(flag: str, price: str) -> str:
    other = "s.Quantity, s.Discount AS ItemDiscount, s.LicenseFactor"
    return f"""
SELECT q.request_id, i.ItemName, CAST(s.Price AS DECIMAL(23,8)) AS ItemPrice, {other}
FROM c_renewals q JOIN detail s ON q.LicensePackageID = s.PackageID LEFT JOIN item i ON s.ItemID = i.ItemID
WHERE NOT ({flag})
UNION ALL SELECT q.request_id, i.ItemName, {price} AS ItemPrice, {other} FROM c_renewals q
  JOIN change_items m ON q.PrevPackageID = m.LicensePackageID AND q.PrevChangeID = m.LicensePackageChangeID
  LEFT JOIN detail_log s ON m.LicensePackageID = s.PackageID AND m.LatestDetailGroupChangeID = s.DetailGroupChangeID
    AND m.ItemID = s.ItemID
  LEFT JOIN item i ON s.ItemID = i.ItemID WHERE ({flag}) AND q.InHistory
UNION ALL SELECT q.request_id, i.ItemName, {price} AS ItemPrice, {other}
FROM c_renewals q JOIN detail s ON q.PrevPackageID = s.PackageID LEFT JOIN item i ON s.ItemID = i.ItemID
WHERE ({flag}) AND NOT q.InHistory
UNION ALL SELECT request_id, '', NULL, NULL, NULL, NULL FROM (SELECT request_id, unnest(range(5)) FROM c_renewals) k"""


EARLIER = ("CAST((s.Price - s.Price * s.Discount) + (s.Price - s.Price * s.Discount) * s.LicenseFactor"
           " AS DECIMAL(23,8))")
C["active_header"] = _active_header("FillHeader")
C["active_items"] = _active_items("FillItems", unit("s.Price", "s.Discount", "s.LicenseFactor"))
C["active_header_editing"] = _active_header("NOT Editing AND FillHeader")
C["active_items_editing"] = _active_items("NOT Editing AND FillItems", EARLIER)
C["active_header_v0"] = f"""
SELECT q.request_id, s.LicensedUsers, s.UserMinimum, s.BasePrice, s.PartnerSplitPercentage, s.PackageDiscount,
  {AS_OF} AS DefaultPackageStartDate, s.Note
FROM c_renewals q JOIN c_current_parts s
  ON s.PackageID = CASE WHEN NOT Editing AND FillHeader THEN q.PrevPackageID ELSE q.LicensePackageID END
WHERE Editing OR s.HasBase"""
C["active_items_v0"] = f"""
SELECT q.request_id, i.ItemName, CAST(s.Price AS DECIMAL(23,8)) AS ItemPrice, s.Quantity, s.Discount AS ItemDiscount,
  s.LicenseFactor
FROM c_renewals q JOIN detail s ON q.LicensePackageID = s.PackageID LEFT JOIN item i ON s.ItemID = i.ItemID WHERE Editing
UNION ALL SELECT q.request_id, i.ItemName, CAST(s.Price + s.Price * s.LicenseFactor AS DECIMAL(23,8)), s.Quantity,
  s.Discount, s.LicenseFactor
FROM c_renewals q JOIN header h ON h.PackageID = CASE WHEN FillItems THEN q.PrevPackageID ELSE q.LicensePackageID END
  LEFT JOIN detail s ON h.PackageID = s.PackageID LEFT JOIN item i ON s.ItemID = i.ItemID WHERE NOT Editing"""
C["renewal_item_price"] = f"""
SELECT s.PackageID, s.ItemID, {unit()} AS FinalPrice, {EARLIER} AS EarlierPrice,
  CAST(s.Price + s.Price * s.LicenseFactor AS DECIMAL(23,8)) AS EarliestPrice FROM detail s"""

# Lookups and scalar rules

_INVENTORY = """SELECT i.ItemID, i.ItemName, i.DefaultPrice, l.Updated
FROM item i LEFT JOIN item_log l ON i.ItemChangeID = l.ItemChangeID"""
C["inventory_search"] = _INVENTORY
C["inventory_search_text"] = _INVENTORY + " WHERE i.ItemName ILIKE '%in%'"
C["client_lookup"] = "SELECT ClientName FROM client WHERE ClientName ILIKE '%#0000%'"
C["lookup_many"] = """
SELECT search_id, ClientName FROM name_searches JOIN client ON CASE search_id % 6
  WHEN 1 THEN lower(ClientName) LIKE '%0_' || search_id || '%' WHEN 2 THEN regexp_matches(ClientName, '[0-4]' || search_id)
  WHEN 3 THEN coalesce(trim(SearchText), '') = '' OR contains(lower(ClientName), lower(SearchText))
  WHEN 5 THEN regexp_matches(lower(ClientName), 'cust.*[^' || (search_id % 10) || '].' || search_id)
  ELSE contains(lower(ClientName), lower(SearchText)) END"""
C["search_errors"] = """
SELECT search_id, 'the start date filter entered could not be interpreted' AS ErrorText FROM expiring_searches
WHERE StartYM LIKE '%.%'"""
C["expiring_finder_many"] = f"""
SELECT search_id, f.* FROM expiring_searches s JOIN ({_expiring('true')}) f ON NOT StartYM LIKE '%.%'
  AND (StartYM = '' OR EndYM IS NULL OR f.LicenseExpirationDate BETWEEN strptime(StartYM || '-01', '%Y-%m-%d')::DATE
    AND strptime(EndYM || '/01', '%Y/%m/%d')::DATE)
  AND lower(f.ClientName) LIKE '%' || ClientText || '%' AND (PartnerText = '' OR lower(f.ClientPartnerName) LIKE '%' || PartnerText || '%')"""
C["partner_lookup"] = "SELECT ClientName AS ClientPartnerName FROM client"
C["item_lookup"] = "SELECT ItemName FROM item WHERE regexp_matches(lower(ItemName), '[rs].*g')"
C["location_lookup"] = """
SELECT DISTINCT c.ClientName, h.Location FROM header_log h JOIN client c ON h.ClientID = c.ClientID
WHERE h.Location ILIKE '%_1%'"""
V["c_texts"] = """
SELECT o_orderkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y/%m')
  WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y.%m') WHEN '5-LOW' THEN concat('2020/', strftime(o_orderdate, '%d'))
  ELSE ' ' END AS YearMonth FROM orders"""
C["year_month_check"] = """
SELECT o_orderkey, YearMonth,
  CAST(try_cast(concat(substring(YearMonth, 1, 4), '-', substring(YearMonth, 6, 2), '-01') AS DATE) AS DATE) AS MonthStart,
  CASE WHEN rtrim(YearMonth) = '' THEN 0 WHEN substring(YearMonth, 5, 1) NOT IN ('-', '/') THEN 1
    WHEN CAST(substring(YearMonth, 6, 2) AS INT) BETWEEN 1 AND 12 THEN 0 ELSE 1 END AS InError
FROM c_texts"""
C["yes_no_check"] = """
SELECT request_id, CAST(lower(AutofillHeader) IN ('yes', 'y', '1') AS INT) AS AutofillHeader,
  CAST(lower(AutofillItems) IN ('yes', 'y', '1') AS INT) AS AutofillItems,
  CAST(lower(EditingMode) IN ('yes', 'y', '1') AS INT) AS EditingMode FROM renewal_requests"""

# Reading and checking a batch

C["parse_lines"] = """
SELECT d.PackageID * 1000000 + d.ItemID AS submission_id, 1 AS RowNo, i.ItemName, d.Price AS ItemPrice, d.Quantity,
  d.Discount AS ItemDiscount, CAST(NULL AS DECIMAL(5,4)) AS LicenseFactor
FROM detail d JOIN item i ON d.ItemID = i.ItemID WHERE d.Discount NOT IN (0, 0.1) AND d.LicenseFactor <> 0.08
UNION ALL
SELECT d.PackageID * 1000000 + d.ItemID, 2, 'setup & training', 95.5, NULL, NULL, NULL
FROM detail d WHERE d.Discount NOT IN (0, 0.1) AND d.LicenseFactor = 0"""
C["parse_files"] = """
SELECT CAST(d.ItemID AS INT) AS RowNo, i.ItemName, d.Price AS ItemPrice, d.Quantity, d.Discount AS ItemDiscount, d.LicenseFactor
FROM detail d JOIN item i ON d.ItemID = i.ItemID WHERE d.Price IS NOT NULL AND d.Quantity IS NOT NULL"""
C["parse_errors"] = """
SELECT PackageID * 1000000 + ItemID AS submission_id, CASE WHEN Discount = 0.1
  THEN 'Error in parsing XML: the document is malformed'
  ELSE 'Error in parsing XML: a value could not be converted' END AS ParseError
FROM detail WHERE Discount = 0.1 OR (Discount <> 0 AND LicenseFactor = 0.08)"""
V["c_known"] = "SELECT s.*, EXISTS (SELECT 1 FROM header h WHERE h.PackageID = s.PackageID) AND s.PackageID <> 0 AS Known FROM submissions s"
V["c_final"] = """
SELECT submission_id, PackageID AS FinalPackageID, 0 AS IsNew FROM c_known WHERE Known
UNION ALL
SELECT submission_id, (SELECT max(PackageID) FROM header) + row_number() OVER (ORDER BY submission_id), 1
FROM c_known WHERE NOT Known"""
C["assign_package_ids"] = "SELECT * FROM c_final"
V["c_last_version"] = "SELECT PackageID, max(ChangeID) AS Last FROM change_log GROUP BY PackageID"
C["next_package_change_id"] = """
SELECT DISTINCT FinalPackageID AS PackageID, coalesce(Last + 1, 1) AS ChangeID
FROM c_final f LEFT JOIN c_last_version v ON f.FinalPackageID = v.PackageID"""
V["c_item_names"] = "SELECT lower(rtrim(ItemName)) AS n, min(ItemID) AS ItemID FROM item GROUP BY 1"
V["c_client_names"] = "SELECT lower(rtrim(ClientName)) AS n, min(ClientID) AS ClientID FROM client GROUP BY 1"
V["c_resolved"] = """
SELECT l.*, i.ItemID FROM submission_lines l LEFT JOIN c_item_names i ON lower(rtrim(l.ItemName)) = i.n"""
C["resolve_items"] = """
SELECT l.submission_id, l.RowNo, l.ItemName, l.ItemID, d.DetailItemChangeID AS LastDetailItemChangeID
FROM c_resolved l JOIN c_final s ON l.submission_id = s.submission_id
  LEFT JOIN detail d ON d.PackageID = s.FinalPackageID AND d.ItemID = l.ItemID"""
V["c_headers"] = """
SELECT s.*, c.ClientID, p.ClientID AS ClientPartnerID, CASE WHEN c.ClientID IS NULL
    THEN ' ClientName entered does not match any entries in the database. Please only enter client names from the dropdown list.'
  WHEN rtrim(s.ClientPartnerName) <> '' AND p.ClientID IS NULL
    THEN ' ClientPartnerName entered does not match any entries in the database. Please only enter client partner names from the dropdown list.'
  END AS HeaderError
FROM submissions s LEFT JOIN c_client_names c ON lower(rtrim(s.ClientName)) = c.n
  LEFT JOIN c_client_names p ON lower(rtrim(s.ClientPartnerName)) = p.n AND rtrim(s.ClientPartnerName) <> ''"""
C["validate_header"] = "SELECT submission_id, ClientID, ClientPartnerID, HeaderError FROM c_headers"
V["c_lines"] = """
SELECT l.*, concat(
  CASE WHEN ItemID IS NOT NULL AND count(*) OVER (PARTITION BY submission_id, ItemID) > 1
    THEN ', Duplicate key (two or more entries of the same item is forbidden)' ELSE '' END,
  CASE WHEN ItemID IS NULL THEN ', Item entered was not found in the database: please check the Inventory report and only enter items which exist there' ELSE '' END,
  CASE WHEN ItemPrice = 0 OR ItemPrice IS NULL THEN ', Price should not be left blank' ELSE '' END,
  CASE WHEN Quantity = 0 OR Quantity IS NULL THEN ', Quantity should not be left blank' ELSE '' END) AS LineErrors
FROM c_resolved l"""
C["validate_lines"] = "SELECT submission_id, RowNo, ItemID, LineErrors FROM c_lines"
V["c_errors_of_batch"] = """
SELECT h.*, CASE WHEN HeaderError IS NOT NULL THEN HeaderError
  WHEN PackageID <> 0 AND count(*) OVER (PARTITION BY PackageID) > 1 THEN 'The package occurs more than once in this batch.'
  WHEN EXISTS (SELECT 1 FROM c_lines l WHERE l.submission_id = h.submission_id AND LineErrors <> '')
    THEN 'There were errors in the details of your input.  Please review the errors noted in each row.' END AS ErrorText
FROM c_headers h"""
C["submission_errors"] = "SELECT submission_id, ErrorText FROM c_errors_of_batch WHERE ErrorText IS NOT NULL"
V["c_ok"] = """
SELECT e.*, EXISTS (SELECT 1 FROM header h WHERE h.PackageID = e.PackageID) AND e.PackageID <> 0 AS Known
FROM c_errors_of_batch e WHERE ErrorText IS NULL"""
V["c_accepted"] = """
SELECT submission_id, PackageID AS pid, ClientID, ClientPartnerID, Location, UserMinimum, PackageDiscount, PartnerSplit,
  LicenseStartDate, LicenseExpirationDate, Note, LoginName FROM c_ok WHERE Known
UNION ALL
SELECT submission_id, (SELECT max(PackageID) FROM header) + row_number() OVER (ORDER BY submission_id), ClientID,
  ClientPartnerID, Location, UserMinimum, PackageDiscount, PartnerSplit, LicenseStartDate, LicenseExpirationDate, Note,
  LoginName FROM c_ok WHERE NOT Known"""
V["c_ok_lines"] = "SELECT a.pid, l.* FROM c_lines l JOIN c_accepted a ON l.submission_id = a.submission_id"

# Lines, first schema

V["c_old_lines"] = "SELECT * FROM detail WHERE PackageID IN (SELECT pid FROM c_accepted)"
V["c_diff"] = """
SELECT coalesce(o.PackageID, n.pid) AS PackageID, coalesce(o.ItemID, n.ItemID) AS ItemID, n.RowNo,
  CASE WHEN o.PackageID IS NULL THEN 'INSERT' WHEN n.pid IS NULL THEN 'DELETE'
    WHEN o.Price <> n.ItemPrice OR o.Quantity <> n.Quantity OR o.Discount <> n.ItemDiscount
      OR o.LicenseFactor <> n.LicenseFactor THEN 'UPDATE' ELSE 'NONE' END AS Action,
  o.Price AS OldPrice, o.Quantity AS OldQuantity, o.Discount AS OldDiscount, o.LicenseFactor AS OldLicenseFactor,
  n.ItemPrice AS NewPrice, n.Quantity AS NewQuantity, n.ItemDiscount AS NewDiscount,
  n.LicenseFactor AS NewLicenseFactor, o.DetailItemChangeID AS OldDetailItemChangeID
FROM c_old_lines o FULL JOIN c_ok_lines n ON o.PackageID = n.pid AND o.ItemID = n.ItemID"""
C["diff_details"] = "SELECT * FROM c_diff"
# Unread documents: cut off, or with a quantity that is no number in any line.
V["c_doc_unread"] = """
SELECT submission_id, CASE WHEN submission_id % 7 = 3 THEN 'Error in parsing XML: the document is malformed'
  ELSE 'Error in parsing XML: a value could not be converted' END AS ParseError
FROM submissions s WHERE submission_id % 7 = 3 OR (submission_id % 11 = 5 AND submission_id IN (SELECT submission_id FROM submission_lines))"""
V["c_doc_ok"] = """
SELECT submission_id, pid FROM c_accepted WHERE submission_id NOT IN (SELECT submission_id FROM c_doc_unread)"""
C["save_from_documents"] = """
SELECT e.submission_id, CAST(NULL AS BIGINT) AS PackageID, CAST(NULL AS BIGINT) AS ItemID, coalesce(u.ParseError, e.ErrorText) AS Outcome
FROM c_errors_of_batch e LEFT JOIN c_doc_unread u ON e.submission_id = u.submission_id
WHERE coalesce(u.ParseError, e.ErrorText) IS NOT NULL
UNION ALL
SELECT NULL, coalesce(o.PackageID, n.fid), coalesce(o.ItemID, n.ItemID),
  CASE WHEN o.PackageID IS NULL THEN 'INSERT' WHEN n.pid IS NULL THEN 'DELETE'
    WHEN o.Price <> n.ItemPrice OR o.Quantity <> n.Quantity OR o.Discount <> n.ItemDiscount
      OR o.LicenseFactor <> n.LicenseFactor THEN 'UPDATE' ELSE 'NONE' END
FROM (SELECT * FROM detail WHERE PackageID IN (SELECT pid FROM c_doc_ok)) o
  FULL JOIN (SELECT l.*, f.fid FROM c_ok_lines l JOIN c_doc_final f ON l.submission_id = f.submission_id) n
  ON o.PackageID = n.fid AND o.ItemID = n.ItemID"""
# New packages are numbered among the submissions that were read.
V["c_doc_final"] = """
SELECT k.submission_id, k.pid AS fid FROM c_doc_ok k WHERE k.pid <= (SELECT max(PackageID) FROM header)
UNION ALL
SELECT k.submission_id, (SELECT max(PackageID) FROM header) + row_number() OVER (ORDER BY k.submission_id)
FROM c_doc_ok k WHERE k.pid > (SELECT max(PackageID) FROM header)"""
V["c_line_change"] = """
SELECT o.PackageID, max(CASE WHEN n.pid IS NULL OR o.Price IS NULL OR n.ItemPrice IS NULL OR o.Price <> n.ItemPrice
  OR o.Quantity IS NULL OR n.Quantity IS NULL OR o.Quantity <> n.Quantity
  OR o.Discount IS NULL OR n.ItemDiscount IS NULL OR o.Discount <> n.ItemDiscount
  OR o.LicenseFactor IS NULL OR n.LicenseFactor IS NULL OR o.LicenseFactor <> n.LicenseFactor
  THEN 1 ELSE 0 END) AS DetailsChanged
FROM c_old_lines o LEFT JOIN c_ok_lines n ON o.PackageID = n.pid AND o.ItemID = n.ItemID GROUP BY o.PackageID"""
C["details_changed"] = "SELECT * FROM c_line_change"
V["c_item_ids"] = "SELECT PackageID, ItemID, max(DetailItemChangeID) AS LastID, max(DetailGroupChangeID) AS LastGroup FROM detail_log GROUP BY 1, 2"
V["c_groups"] = "SELECT PackageID, max(DetailGroupChangeID) + 1 AS NextGroup FROM detail_log GROUP BY 1"


def _new_lines(insert_id: str) -> str:
    return f"""
SELECT PackageID, ItemID, Price, Quantity, Discount, LicenseFactor, DetailItemChangeID FROM detail
WHERE PackageID NOT IN (SELECT pid FROM c_accepted)
UNION ALL
SELECT d.PackageID, d.ItemID, CASE Action WHEN 'NONE' THEN OldPrice ELSE NewPrice END,
  CASE Action WHEN 'NONE' THEN OldQuantity ELSE NewQuantity END,
  CASE Action WHEN 'NONE' THEN OldDiscount ELSE NewDiscount END,
  CASE Action WHEN 'NONE' THEN OldLicenseFactor ELSE NewLicenseFactor END,
  CASE Action WHEN 'NONE' THEN OldDetailItemChangeID WHEN 'UPDATE' THEN OldDetailItemChangeID + 1 ELSE {insert_id} END
FROM c_diff d LEFT JOIN c_item_ids m ON d.PackageID = m.PackageID AND d.ItemID = m.ItemID WHERE Action <> 'DELETE'"""


C["apply_details"] = _new_lines("1")
C["fix_readded_item_ids"] = _new_lines("coalesce(m.LastID + 1, 1)")
V["c_detail_log_rows"] = """
SELECT d.PackageID, coalesce(m.LastID + 1, 1) AS DetailItemChangeID, d.ItemID,
  coalesce(g.NextGroup, 1) AS DetailGroupChangeID, coalesce(OldPrice, NewPrice) AS Price,
  coalesce(OldQuantity, NewQuantity) AS Quantity, coalesce(OldDiscount, NewDiscount) AS Discount,
  coalesce(OldLicenseFactor, NewLicenseFactor) AS LicenseFactor, Action AS Operation
FROM c_diff d LEFT JOIN c_item_ids m ON d.PackageID = m.PackageID AND d.ItemID = m.ItemID
  LEFT JOIN c_groups g ON d.PackageID = g.PackageID WHERE Action <> 'NONE'"""
C["detail_log_rows"] = "SELECT * FROM c_detail_log_rows"

# Header, partner and note, first schema

V["c_header_diff"] = """
SELECT a.*, o.ClientID AS oc, o.Location AS ol, o.LicenseStartDate AS os, o.LicenseExpirationDate AS oe,
  o.PackageDiscount AS od, o.UserMinimum AS ou, o.HeaderChangeID AS oid, o.Inactive AS oi,
  CASE WHEN o.PackageID IS NULL THEN 'INSERT' WHEN o.ClientID <> a.ClientID
    OR lower(rtrim(o.Location)) <> lower(rtrim(a.Location)) OR o.UserMinimum <> a.UserMinimum
    OR o.PackageDiscount <> a.PackageDiscount OR o.LicenseStartDate <> a.LicenseStartDate
    OR o.LicenseExpirationDate <> a.LicenseExpirationDate THEN 'UPDATE' ELSE 'NONE' END AS Action
FROM c_accepted a LEFT JOIN header o ON a.pid = o.PackageID"""
C["apply_header"] = """
SELECT PackageID, ClientID, Location, LicenseStartDate, LicenseExpirationDate, PackageDiscount, UserMinimum,
  HeaderChangeID, Inactive FROM header WHERE PackageID NOT IN (SELECT pid FROM c_header_diff WHERE Action = 'UPDATE')
UNION ALL
SELECT pid, ClientID, Location, LicenseStartDate, LicenseExpirationDate, PackageDiscount, UserMinimum,
  coalesce(oid + 1, 1), 0 FROM c_header_diff WHERE Action <> 'NONE'"""
V["c_header_log_rows"] = """
SELECT pid AS PackageID, coalesce(oid + 1, 1) AS HeaderChangeID, coalesce(oc, ClientID) AS ClientID,
  coalesce(ol, Location) AS Location, coalesce(os, LicenseStartDate) AS LicenseStartDate,
  coalesce(oe, LicenseExpirationDate) AS LicenseExpirationDate, coalesce(od, PackageDiscount) AS PackageDiscount,
  coalesce(ou, UserMinimum) AS UserMinimum, coalesce(oi, 0) AS Inactive, Action AS Operation
FROM c_header_diff WHERE Action <> 'NONE'"""
C["header_log_rows"] = "SELECT * FROM c_header_log_rows"
V["c_partner_diff"] = """
SELECT a.pid, a.ClientPartnerID AS n, a.PartnerSplit AS ns, o.ClientPartnerID AS o, o.PartnerSplitPercentage AS os,
  o.ClientPartnerChangeID AS oid,
  CASE WHEN a.ClientPartnerID IS NULL AND o.PackageID IS NOT NULL THEN 'DELETE' WHEN a.ClientPartnerID IS NULL THEN 'NONE'
    WHEN o.PackageID IS NULL THEN 'INSERT'
    WHEN o.ClientPartnerID <> a.ClientPartnerID OR o.PartnerSplitPercentage <> a.PartnerSplit THEN 'UPDATE'
    ELSE 'NONE' END AS Action,
  coalesce((SELECT max(ClientPartnerChangeID) + 1 FROM partner_log g WHERE g.PackageID = a.pid), 1) AS first_id
FROM c_accepted a LEFT JOIN partner o ON a.pid = o.PackageID"""
C["apply_partner"] = """
SELECT PackageID, ClientPartnerID, PartnerSplitPercentage, ClientPartnerChangeID FROM partner
WHERE PackageID NOT IN (SELECT pid FROM c_partner_diff WHERE Action <> 'NONE')
UNION ALL
SELECT pid, n, ns, CASE Action WHEN 'INSERT' THEN first_id ELSE oid + 1 END FROM c_partner_diff
WHERE Action IN ('INSERT', 'UPDATE')"""
V["c_partner_log_rows"] = """
SELECT pid AS PackageID, CASE Action WHEN 'INSERT' THEN first_id ELSE oid + 1 END AS ClientPartnerChangeID,
  coalesce(o, n) AS ClientPartnerID, coalesce(os, ns) AS PartnerSplitPercentage, Action AS Operation
FROM c_partner_diff WHERE Action <> 'NONE'"""
C["partner_log_rows"] = "SELECT * FROM c_partner_log_rows"
V["c_note_diff"] = """
SELECT a.pid, a.Note AS n, a.LoginName, o.Note AS o, o.NoteChangeID AS oid,
  CASE WHEN o.PackageID IS NULL AND rtrim(a.Note) <> '' THEN 'INSERT'
    WHEN lower(rtrim(o.Note)) <> lower(rtrim(a.Note)) THEN 'UPDATE' ELSE 'NONE' END AS Action
FROM c_accepted a LEFT JOIN note o ON a.pid = o.PackageID"""
C["apply_note"] = """
SELECT PackageID, Note, NoteChangeID FROM note WHERE PackageID NOT IN (SELECT pid FROM c_note_diff WHERE Action <> 'NONE')
UNION ALL SELECT pid, n, coalesce(oid + 1, 1) FROM c_note_diff WHERE Action <> 'NONE'"""
V["c_next"] = """
SELECT pid, coalesce((SELECT max(ChangeID) + 1 FROM change_log v WHERE v.PackageID = a.pid), 1) AS NextChange
FROM c_accepted a"""
V["c_note_log_rows"] = f"""
SELECT d.pid AS PackageID, coalesce(oid + 1, 1) AS NoteChangeID, coalesce(o, n) AS Note, Action AS Operation,
  NextChange AS LicPackageChangeID, {AS_OF} AS Updated, LoginName AS UpdatedBy
FROM c_note_diff d JOIN c_next x ON d.pid = x.pid WHERE Action <> 'NONE'"""
C["note_log_rows"] = "SELECT * FROM c_note_log_rows"

# Versions

V["c_changed"] = """
SELECT PackageID AS pid FROM c_header_log_rows UNION SELECT PackageID FROM c_detail_log_rows
UNION SELECT PackageID FROM c_partner_log_rows UNION SELECT PackageID FROM c_note_log_rows"""
V["c_all_header_log"] = "SELECT PackageID, HeaderChangeID FROM header_log UNION ALL SELECT PackageID, HeaderChangeID FROM c_header_log_rows"
V["c_all_detail_log"] = "SELECT PackageID, DetailGroupChangeID FROM detail_log UNION ALL SELECT PackageID, DetailGroupChangeID FROM c_detail_log_rows"
V["c_all_partner_log"] = "SELECT PackageID, ClientPartnerChangeID FROM partner_log UNION ALL SELECT PackageID, ClientPartnerChangeID FROM c_partner_log_rows"
V["c_all_note_log"] = "SELECT PackageID, NoteChangeID FROM note_log UNION ALL SELECT PackageID, NoteChangeID FROM c_note_log_rows"
C["change_log_rows"] = f"""
SELECT h.PackageID, x.NextChange AS ChangeID, max(h.HeaderChangeID) AS HeaderChangeID,
  max(d.DetailGroupChangeID) AS DetailGroupChangeID, max(p.ClientPartnerChangeID) AS ClientPartnerChangeID,
  max(n.NoteChangeID) AS NoteChangeID, {AS_OF} AS Updated, a.LoginName AS UpdatedBy
FROM c_all_header_log h LEFT JOIN c_all_detail_log d ON h.PackageID = d.PackageID
  LEFT JOIN c_all_partner_log p ON h.PackageID = p.PackageID LEFT JOIN c_all_note_log n ON h.PackageID = n.PackageID
  JOIN c_next x ON h.PackageID = x.pid JOIN c_accepted a ON h.PackageID = a.pid
WHERE h.PackageID IN (SELECT pid FROM c_changed) GROUP BY h.PackageID, x.NextChange, a.LoginName"""
V["c_members_after"] = """
SELECT d.PackageID, d.ItemID, CASE WHEN Action = 'NONE' THEN m.LastGroup ELSE coalesce(g.NextGroup, 1) END AS LatestGroup
FROM c_diff d LEFT JOIN c_item_ids m ON d.PackageID = m.PackageID AND d.ItemID = m.ItemID
  LEFT JOIN c_groups g ON d.PackageID = g.PackageID WHERE Action <> 'DELETE'"""
C["change_items_rows"] = """
SELECT o.PackageID AS LicensePackageID, x.NextChange AS LicensePackageChangeID, o.ItemID,
  m.LastGroup AS LatestDetailGroupChangeID
FROM c_old_lines o JOIN c_line_change f ON o.PackageID = f.PackageID AND f.DetailsChanged = 1
  JOIN c_next x ON o.PackageID = x.pid LEFT JOIN c_item_ids m ON o.PackageID = m.PackageID AND o.ItemID = m.ItemID
UNION ALL
SELECT a.PackageID, x.NextChange, a.ItemID, 1 FROM c_members_after a JOIN c_next x ON a.PackageID = x.pid
WHERE a.PackageID NOT IN (SELECT PackageID FROM c_old_lines)
UNION ALL
SELECT a.PackageID, x.NextChange, a.ItemID, a.LatestGroup
FROM c_members_after a JOIN c_next x ON a.PackageID = x.pid JOIN c_line_change f ON a.PackageID = f.PackageID
WHERE f.DetailsChanged = 0 AND a.PackageID IN (SELECT pid FROM c_changed)"""
C["change_items_rows_post"] = """
SELECT a.PackageID AS LicensePackageID, x.NextChange AS LicensePackageChangeID, a.ItemID,
  a.LatestGroup AS LatestDetailGroupChangeID
FROM c_members_after a JOIN c_next x ON a.PackageID = x.pid WHERE a.PackageID IN (SELECT pid FROM c_changed)"""
C["row_messages"] = """
SELECT n.submission_id, n.RowNo, CASE d.Action WHEN 'INSERT' THEN 'Added!' WHEN 'UPDATE' THEN 'Updated!' ELSE '' END AS MessageToUser
FROM c_ok_lines n JOIN c_diff d ON n.pid = d.PackageID AND n.ItemID = d.ItemID
UNION ALL
SELECT l.submission_id, l.RowNo, CASE WHEN starts_with(e.ErrorText, 'There were') THEN substring(l.LineErrors, 3) ELSE '' END
FROM c_lines l JOIN c_errors_of_batch e ON l.submission_id = e.submission_id WHERE e.ErrorText IS NOT NULL"""
C["save_measures"] = """
SELECT a.submission_id, a.pid AS FinalPackageID, l.Quantity AS LicensedUsers, l.ItemPrice AS BasePrice
FROM c_accepted a LEFT JOIN c_ok_lines l ON a.submission_id = l.submission_id AND l.ItemID = 5"""
C["dry_run"] = f"""
SELECT 'refused' AS Frame, count(*) AS RowCount FROM c_errors_of_batch WHERE ErrorText IS NOT NULL
UNION ALL SELECT 'header', count(*) FROM c_accepted
UNION ALL SELECT 'detail', count(*) FROM c_diff WHERE Action <> 'DELETE'
UNION ALL SELECT 'partner', count(*) FROM c_partner_diff WHERE n IS NOT NULL
UNION ALL SELECT 'note', count(*) FROM c_note_diff WHERE o IS NOT NULL OR Action = 'INSERT'
UNION ALL SELECT 'header_log', count(*) FROM c_header_log_rows
UNION ALL SELECT 'detail_log', count(*) FROM c_detail_log_rows
UNION ALL SELECT 'partner_log', count(*) FROM c_partner_log_rows
UNION ALL SELECT 'note_log', count(*) FROM c_note_log_rows
UNION ALL SELECT 'change_log', count(*) FROM c_changed
UNION ALL SELECT 'change_items', count(*) FROM ({C['change_items_rows']}) z"""

# Second schema

V["c_soft_pairs"] = """
SELECT coalesce(o.PackageID, n.pid) AS PackageID, coalesce(o.ItemID, n.ItemID) AS ItemID,
  CASE WHEN o.PackageID IS NULL THEN 'INSERT' WHEN n.pid IS NULL AND o.Inactive = 0 THEN 'DELETE' WHEN n.pid IS NULL THEN 'NONE'
    WHEN o.Inactive = 1 OR o.Price <> n.ItemPrice OR o.Quantity <> n.Quantity OR o.Discount <> n.ItemDiscount
      OR o.LicenseFactor <> n.LicenseFactor THEN 'UPDATE' ELSE 'NONE' END AS Action,
  o.Price AS op, o.Quantity AS oq, o.Discount AS od, o.LicenseFactor AS ol,
  n.ItemPrice AS np, n.Quantity AS nq, n.ItemDiscount AS nd, n.LicenseFactor AS nl,
  CASE WHEN n.pid IS NULL THEN 1 ELSE 0 END AS Inactive, o.ChangeID AS oid
FROM (SELECT * FROM soft_detail WHERE PackageID IN (SELECT pid FROM c_accepted)) o
  FULL JOIN c_ok_lines n ON o.PackageID = n.pid AND o.ItemID = n.ItemID"""
# Only an added or changed line takes the submitted values; a line without a change keeps its NULLs.
V["c_soft_diff"] = """
SELECT PackageID, ItemID, Action, CASE WHEN Action IN ('INSERT', 'UPDATE') THEN np ELSE op END AS Price,
  CASE WHEN Action IN ('INSERT', 'UPDATE') THEN nq ELSE oq END AS Quantity,
  CASE WHEN Action IN ('INSERT', 'UPDATE') THEN nd ELSE od END AS Discount,
  CASE WHEN Action IN ('INSERT', 'UPDATE') THEN nl ELSE ol END AS LicenseFactor, Inactive, oid
FROM c_soft_pairs"""
C["apply_details_soft"] = """
SELECT PackageID, ItemID, Price, Quantity, Discount, LicenseFactor, Inactive, ChangeID FROM soft_detail
WHERE PackageID NOT IN (SELECT pid FROM c_accepted)
UNION ALL
SELECT PackageID, ItemID, Price, Quantity, Discount, LicenseFactor, Inactive,
  CASE Action WHEN 'INSERT' THEN 1 WHEN 'NONE' THEN oid ELSE oid + 1 END FROM c_soft_diff"""
V["c_soft_detail_log_rows"] = """
SELECT d.PackageID, coalesce((SELECT max(ChangeID) + 1 FROM soft_detail_log g
    WHERE g.PackageID = d.PackageID AND g.ItemID = d.ItemID), 1) AS ChangeID,
  d.ItemID, Price, Quantity, Discount, LicenseFactor, Inactive,
  CASE Action WHEN 'INSERT' THEN 'INSERT' ELSE 'UPDATE' END AS Operation
FROM c_soft_diff d WHERE Action <> 'NONE'"""
C["detail_log_rows_post"] = "SELECT * FROM c_soft_detail_log_rows"
V["c_soft_header"] = """
SELECT a.pid AS PackageID, a.ClientID, a.Location, a.LicenseStartDate, a.LicenseExpirationDate, a.PackageDiscount,
  a.UserMinimum, coalesce(o.Inactive, 0) AS Inactive, coalesce(o.ChangeID + 1, 1) AS ChangeID,
  CASE WHEN o.PackageID IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS Operation
FROM c_accepted a LEFT JOIN soft_header o ON a.pid = o.PackageID"""
C["apply_header_soft"] = """
SELECT PackageID, ClientID, Location, LicenseStartDate, LicenseExpirationDate, PackageDiscount, UserMinimum, Inactive,
  ChangeID FROM soft_header WHERE PackageID NOT IN (SELECT pid FROM c_accepted)
UNION ALL SELECT PackageID, ClientID, Location, LicenseStartDate, LicenseExpirationDate, PackageDiscount, UserMinimum,
  Inactive, ChangeID FROM c_soft_header"""
C["header_log_rows_soft"] = "SELECT * FROM c_soft_header"
V["c_soft_partner"] = """
SELECT a.pid AS PackageID, coalesce(a.ClientPartnerID, o.ClientPartnerID) AS ClientPartnerID,
  CASE WHEN a.ClientPartnerID IS NULL THEN o.PartnerSplitPercentage ELSE a.PartnerSplit END AS PartnerSplitPercentage,
  CASE WHEN a.ClientPartnerID IS NULL THEN 1 ELSE 0 END AS Inactive,
  CASE WHEN o.PackageID IS NULL
    THEN coalesce((SELECT max(ChangeID) + 1 FROM soft_partner_log g WHERE g.PackageID = a.pid), 1)
    ELSE o.ChangeID + 1 END AS ChangeID,
  CASE WHEN o.PackageID IS NULL THEN 'INSERT' WHEN a.ClientPartnerID IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS Operation
FROM c_accepted a LEFT JOIN soft_partner o ON a.pid = o.PackageID
WHERE (a.ClientPartnerID IS NOT NULL AND (o.PackageID IS NULL OR o.Inactive = 1 OR o.ClientPartnerID <> a.ClientPartnerID
    OR o.PartnerSplitPercentage <> a.PartnerSplit))
  OR (a.ClientPartnerID IS NULL AND o.Inactive = 0)"""
C["apply_partner_soft"] = """
SELECT PackageID, ClientPartnerID, PartnerSplitPercentage, Inactive, ChangeID FROM soft_partner
WHERE PackageID NOT IN (SELECT PackageID FROM c_soft_partner)
UNION ALL SELECT PackageID, ClientPartnerID, PartnerSplitPercentage, Inactive, ChangeID FROM c_soft_partner"""
C["partner_log_rows_soft"] = "SELECT * FROM c_soft_partner"
V["c_soft_note"] = """
SELECT a.pid AS PackageID, CASE WHEN rtrim(a.Note) = '' THEN o.Note ELSE a.Note END AS Note,
  CASE WHEN rtrim(a.Note) = '' THEN 1 ELSE 0 END AS Inactive, coalesce(o.ChangeID + 1, 1) AS ChangeID,
  CASE WHEN o.PackageID IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS Operation
FROM c_accepted a LEFT JOIN soft_note o ON a.pid = o.PackageID
WHERE (o.PackageID IS NULL AND rtrim(a.Note) <> '') OR (rtrim(a.Note) = '' AND o.Inactive = 0)
  OR (rtrim(a.Note) <> '' AND (o.Inactive = 1 OR lower(rtrim(o.Note)) <> lower(rtrim(a.Note))))"""
C["apply_note_soft"] = """
SELECT PackageID, Note, Inactive, ChangeID FROM soft_note WHERE PackageID NOT IN (SELECT PackageID FROM c_soft_note)
UNION ALL SELECT PackageID, Note, Inactive, ChangeID FROM c_soft_note"""
C["note_log_rows_soft"] = "SELECT PackageID, ChangeID, Note, Operation, Inactive FROM c_soft_note"
C["change_log_rows_soft"] = f"""
SELECT a.pid AS PackageID,
  coalesce((SELECT max(ChangeID) + 1 FROM soft_change_log v WHERE v.PackageID = a.pid), 1) AS ChangeID,
  h.ChangeID AS HeaderChangeID,
  greatest((SELECT max(ChangeID) FROM soft_partner_log g WHERE g.PackageID = a.pid), p.ChangeID) AS ClientPartnerChangeID,
  greatest((SELECT max(ChangeID) FROM soft_note_log g WHERE g.PackageID = a.pid), n.ChangeID) AS NoteChangeID,
  {AS_OF} AS Updated, a.LoginName AS UpdatedBy
FROM c_accepted a JOIN c_soft_header h ON a.pid = h.PackageID LEFT JOIN c_soft_partner p ON a.pid = p.PackageID
  LEFT JOIN c_soft_note n ON a.pid = n.PackageID"""


C["dry_run_soft"] = """
SELECT 'refused' AS Frame, count(*) AS RowCount FROM c_errors_of_batch WHERE ErrorText IS NOT NULL
UNION ALL SELECT 'header', count(*) FROM c_accepted
UNION ALL SELECT 'detail', count(*) FROM c_soft_diff
UNION ALL SELECT 'partner', count(*) FROM (SELECT PackageID FROM c_soft_partner UNION
  SELECT PackageID FROM soft_partner WHERE PackageID IN (SELECT pid FROM c_accepted)) z
UNION ALL SELECT 'note', count(*) FROM (SELECT PackageID FROM c_soft_note UNION
  SELECT PackageID FROM soft_note WHERE PackageID IN (SELECT pid FROM c_accepted)) z
UNION ALL SELECT 'header_log', count(*) FROM c_soft_header
UNION ALL SELECT 'detail_log', count(*) FROM c_soft_detail_log_rows
UNION ALL SELECT 'partner_log', count(*) FROM c_soft_partner
UNION ALL SELECT 'note_log', count(*) FROM c_soft_note
UNION ALL SELECT 'change_log', count(*) FROM c_accepted"""

# Logs folded: the row without a later one.
for _part, _keys, _values in [
    ("header", ["PackageID"], ["ClientID", "Location", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount", "UserMinimum"]),
    ("detail", ["PackageID", "ItemID"], ["Price", "Quantity", "Discount", "LicenseFactor"]),
    ("partner", ["PackageID"], ["ClientPartnerID", "PartnerSplitPercentage"]),
    ("note", ["PackageID"], ["Note"]),
]:
    _columns = ", ".join([*_keys, "ChangeID", *_values, "Inactive"])
    _rows = {"detail": "c_soft_detail_log_rows"}.get(_part, f"c_soft_{_part}")
    V[f"c_logged_{_part}"] = f"SELECT {_columns} FROM soft_{_part}_log UNION ALL SELECT {_columns} FROM {_rows}"
    V[f"c_state_{_part}"] = f"""
SELECT {_columns} FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(_keys)} ORDER BY ChangeID DESC) AS nth
  FROM c_logged_{_part}) z WHERE nth = 1"""
C["state_from_logs"] = """
SELECT 'header' AS Part, * FROM c_state_header UNION ALL BY NAME SELECT 'detail' AS Part, * FROM c_state_detail
UNION ALL BY NAME SELECT 'partner' AS Part, * FROM c_state_partner UNION ALL BY NAME SELECT 'note' AS Part, * FROM c_state_note"""
V["c_logged_lines"] = """
SELECT g.* FROM soft_detail_log g WHERE NOT EXISTS (SELECT 1 FROM soft_detail_log l
  WHERE l.PackageID = g.PackageID AND l.ItemID = g.ItemID AND l.ChangeID > g.ChangeID)"""
C["log_drift"] = """
SELECT coalesce(d.PackageID, g.PackageID) AS PackageID, coalesce(d.ItemID, g.ItemID) AS ItemID,
  CASE WHEN g.PackageID IS NULL THEN 'no log' WHEN d.PackageID IS NULL THEN 'no row' ELSE 'differs' END AS Fault
FROM soft_detail d FULL JOIN c_logged_lines g ON d.PackageID = g.PackageID AND d.ItemID = g.ItemID
WHERE d.PackageID IS NULL OR g.PackageID IS NULL OR d.Price IS DISTINCT FROM g.Price OR d.Quantity IS DISTINCT FROM g.Quantity
  OR d.Discount IS DISTINCT FROM g.Discount OR d.LicenseFactor IS DISTINCT FROM g.LicenseFactor
  OR d.Inactive IS DISTINCT FROM g.Inactive OR d.ChangeID IS DISTINCT FROM g.ChangeID"""


def check_sql() -> dict[str, str]:
    return {name: with_views(sql, after=V) for name, sql in C.items()}
