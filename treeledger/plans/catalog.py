"""All queries of the engine by name, and the SQL of those that SQL can express."""

from treeledger.plans import catalog_tables, catalog_text

QUERIES = {**catalog_text.Q, **catalog_tables.Q}
SQL = {**catalog_text.SQL, **catalog_tables.SQL}
