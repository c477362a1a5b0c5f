"""DataFrame operators over depth rasters, point clouds, meshes, boxes and evaluations."""
