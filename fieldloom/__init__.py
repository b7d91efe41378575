"""fieldloom: a PySpark-native engine for meshes, fields and training corpora."""
