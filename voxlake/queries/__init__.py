"""One query for each operator over the driver tables, with its DuckDB SQL."""

from __future__ import annotations

from voxlake.queries import catalogs, details, grids, lines, regions, sheets, spaces, streamlines
from voxlake.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogs", "details", "grids", "lines", "regions", "sheets", "spaces", "streamlines"]
