"""Named queries (``registry``) and their DuckDB twins (``oracle``)."""
