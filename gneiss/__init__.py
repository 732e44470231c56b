"""gneiss: a PySpark-native engine for corpora of structured, step-wise documents."""
