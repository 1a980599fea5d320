"""Spark-native analytics for dated map layers: grids, rasters, features, growth, audits, exports and streams."""
