"""Column names, the inventory schema and its validation (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OBS_DATE = "obs_date"
STORE = "store_id"
PRODUCT = "product_id"
CATEGORY = "category"
INV = "inventory_level"
SOLD = "units_sold"
ORDERED = "units_ordered"
FORECAST = "demand_forecast"
PRICE = "price"
VENDOR = "vendor"
DELIVERY = "vendor_avg_delivery_days"
ROW_SEQ = "row_seq"

# Source CSV header -> engine column (fixed values: the header names of the
# inventory file the dashboard reads).
CSV_HEADERS = {
    "Date": OBS_DATE,
    "Store ID": STORE,
    "Product ID": PRODUCT,
    "Category": CATEGORY,
    "Inventory Level": INV,
    "Units Sold": SOLD,
    "Units Ordered": ORDERED,
    "Demand Forecast": FORECAST,
    "Price": PRICE,
    "Vendor": VENDOR,
    "Vendor Avg Delivery Days": DELIVERY,
}

MEASURES = (INV, SOLD, ORDERED, FORECAST, PRICE, DELIVERY)
TEXTS = (STORE, CATEGORY, VENDOR)

INVENTORY_SCHEMA = T.StructType([
    T.StructField(OBS_DATE, T.DateType()),
    T.StructField(STORE, T.StringType()),
    T.StructField(PRODUCT, T.StringType()),
    T.StructField(CATEGORY, T.StringType()),
    T.StructField(INV, T.DoubleType()),
    T.StructField(SOLD, T.DoubleType()),
    T.StructField(ORDERED, T.DoubleType()),
    T.StructField(FORECAST, T.DoubleType()),
    T.StructField(PRICE, T.DoubleType()),
    T.StructField(VENDOR, T.StringType()),
    T.StructField(DELIVERY, T.DoubleType()),
    T.StructField(ROW_SEQ, T.LongType()),
])

REQUIRED = tuple(f.name for f in INVENTORY_SCHEMA.fields)

# "File order" of the observations.  A distributed read has none, so every
# first/last/top-N breaks ties on these keys: date-major, then the row
# sequence assigned at ingest, which is unique within a date.  A missing date or
# sequence comes last.  Operators take other columns as ``order_cols``.
# ``row_seq`` may be any orderable numeric type: BIGINT from
# ``read_inventory``, DECIMAL(38,0) from the star-schema adapter.
ORDER_COLS = (OBS_DATE, ROW_SEQ)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


class InventorySchemaError(ValueError):
    """Raised when an inventory table lacks a column or has a wrong type."""


def validate_schema(df: DataFrame) -> DataFrame:
    """Check the inventory columns up front; return ``df`` unchanged.

    Only the schema is inspected, so this costs no Spark job.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in REQUIRED if c not in fields]
    if missing:
        raise InventorySchemaError(f"inventory table lacks columns: {missing}")
    bad = [c for c in MEASURES if not isinstance(fields[c], _NUMERIC)]
    if not isinstance(fields[OBS_DATE], (T.DateType, T.TimestampType, T.TimestampNTZType)):
        bad.append(OBS_DATE)
    if bad:
        raise InventorySchemaError(f"inventory columns with wrong types: {bad}")
    return df
