"""A PySpark engine for raster, vector-line and plotter-map analytics."""
