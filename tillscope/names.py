"""Names and fixed values shared by the whole package."""

from __future__ import annotations

# --- Fixed values: these define the data format and must not be changed. ---

# Columns of a raw sales export, in file order.
RAW_COLUMNS = (
    "Date",
    "Time",
    "Time Zone",
    "Category",
    "Item",
    "SKU",
    "Qty",
    "Price Point Name",
    "Gross Sales",
    "Discounts",
    "Net Sales",
    "Tax",
    "Transaction ID",
    "Payment ID",
    "Device Name",
    "Notes",
    "Details",
    "Event Type",
    "Location",
    "Dining Option",
    "Customer Name",
    "Customer ID",
    "Customer Reference ID",
)

# Personal and free-text columns that never get past ingestion.
PRIVATE_COLUMNS = ("customer_name", "customer_id", "customer_reference_id", "notes", "details")

# Columns holding "$12.34" text.
MONEY_COLUMNS = ("gross_sales", "discounts", "net_sales", "tax")

# Sign, dollar mark, digits, at most two decimals; nothing else is money.
MONEY_PATTERN = r"^-?\$\d+(\.\d{1,2})?$"

# Columns of the line-item table, in order; the ones a source lacks are left out.
LINE_ITEM_COLUMNS = (
    "line_item_id",
    "transaction_id",
    "date",
    "transaction_ts",
    "sku",
    "item",
    "category",
    "qty",
    "price_point_name",
    "gross_sales",
    "discounts",
    "net_sales",
    "tax",
)

# Basket-level columns copied from the first line that has them.
HEADER_COLUMNS = ("payment_id", "device_name", "location")

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WEEKEND = ("Friday", "Saturday", "Sunday")
FIRST_DAYS_OF_MONTH = (1, 2, 3)
SUMMER_MONTHS = (6, 7, 8)

# (reported name, column of the KPI row, is money)
KPIS = (
    ("Net Sales", "net_sales", True),
    ("Transactions", "transactions", False),
    ("Average Basket", "avg_basket", True),
    ("Units", "units", False),
    ("Distinct Items Sold", "distinct_items", False),
)

TABLES = ("transactions", "line_items", "daily_item_sales")

# --- Our own choices. ---

MONEY = "decimal(18,2)"

# Number of the file and position in it, kept from the scan until the tables are built.
ROW_ORDER = ("source_file", "source_row")
# The same order with the files numbered.
NUMBERED_ORDER = ("file_no", "source_row")
