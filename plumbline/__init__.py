"""A PySpark-native engine for depth-sensor frames, point clouds, evaluations and experiment ledgers."""
