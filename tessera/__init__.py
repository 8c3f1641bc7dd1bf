"""Tessera: Spark-native geometry, mesh, grid, graph and sparse-matrix analytics."""
