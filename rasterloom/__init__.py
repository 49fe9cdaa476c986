"""rasterloom: gap filling of daily raster cubes as Spark DataFrame jobs."""
