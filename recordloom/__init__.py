"""recordloom: a Spark-native engine that profiles, encodes, frames, decodes and analyses structured records."""
