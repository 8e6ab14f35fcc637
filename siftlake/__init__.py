"""A PySpark-native, storage-aware query layer over Parquet datasets."""
