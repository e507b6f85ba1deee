"""PySpark-native engine for contour, layer and sheet data."""
