"""Reading tables and images as rasters; writing rasters, points and summaries."""
