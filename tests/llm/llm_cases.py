"""Shared by the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"

#: Names that operators might use for columns of their own.
CLASHES = ("doc", "key", "row", "length", "score", "kept", "word", "n_words", "id", "lo", "spans", "fp",
           "bin", "piece", "epoch", "block", "weight", "h", "path", "host", "rule", "level", "json",
           "_key", "_new", "_doc", "_spans", "_th", "_c", "_t", "_d", "h1", "h2", "root")
