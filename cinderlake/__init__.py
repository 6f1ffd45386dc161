"""cinderlake: event analytics and raster-style kernels as Spark DataFrame operators."""
