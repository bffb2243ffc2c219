"""shelfwise: retail inventory analytics as Spark DataFrame plans.

Every public function takes a DataFrame (the inventory observations, or
their enriched form) and returns a lazy DataFrame.  Nothing executes until
the caller runs an action, so Catalyst sees one plan per report: filters and
column pruning reach the Parquet scan, aggregations run partial + final, and
fixed lookup tables are broadcast.
"""

from shelfwise.operators.metrics import enrich
from shelfwise.sources.inventory import read_inventory, save_enriched
from shelfwise.sources.star import star_schema_inventory

__all__ = ["enrich", "read_inventory", "save_enriched", "star_schema_inventory"]
