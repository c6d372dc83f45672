"""Spark-native analytics over archives of dated, authored, itemised documents."""
