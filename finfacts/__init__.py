"""PySpark-native analytics over long-format, versioned business facts."""
