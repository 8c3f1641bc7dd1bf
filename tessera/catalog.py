"""All queries of the library over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import case_queries, geometry_queries, graph_queries, grid_queries, pool_queries, region_queries, surface_queries

FLAGSHIP = "cell_types"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**geometry_queries.QUERIES, **graph_queries.QUERIES, **surface_queries.QUERIES, **region_queries.QUERIES, **grid_queries.QUERIES, **pool_queries.QUERIES, **case_queries.QUERIES}

SQL: dict[str, str] = {**geometry_queries.SQL, **graph_queries.SQL, **surface_queries.SQL, **region_queries.SQL, **grid_queries.SQL, **pool_queries.SQL, **case_queries.SQL}
