"""Spark-native analytics over triangle meshes and signed-distance fields."""
