"""Query registry (``registry``) and the DuckDB oracle twins (``oracle``)."""
