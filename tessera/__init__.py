"""Tessera: a PySpark-native engine over the data a workspace accumulates."""
