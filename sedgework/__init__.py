"""sedgework: a PySpark-native analytics engine for document-collection pipelines."""
