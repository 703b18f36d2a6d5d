"""slidelake: tissue-patch analytics over tiled slides, written for Spark's DataFrame API."""
