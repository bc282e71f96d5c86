"""Inputs: landed API pages (JSON/parquet) and the test-table stand-ins."""
