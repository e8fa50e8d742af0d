"""windgrid: a PySpark-native engine for sparse aircraft observations and text corpora."""
