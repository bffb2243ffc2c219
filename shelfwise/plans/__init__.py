"""Named report plans (the query catalog) and their SQL oracles."""
