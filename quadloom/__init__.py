"""A PySpark-native engine for vector tiles: feature tables in, tilesets out, kept fresh from change streams."""
