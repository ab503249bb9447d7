"""All registered queries and their SQL."""

from tilelake import catalog_regions, catalog_search, catalog_sources  # noqa: F401  (add their queries)
from tilelake.catalog import ORACLE_SQL, QUERIES  # noqa: F401
