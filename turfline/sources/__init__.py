"""Sources and sinks: driver tables, derived fixture tables, raw-format ingest."""

from turfline.sources.tables import read_table, scan_project, register_driver_views  # noqa: F401
