"""Corpus analytics on Spark: declarative operators over text corpora and the experiments run on them."""
