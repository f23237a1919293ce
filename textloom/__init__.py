"""Spark-native analytics for versions of a text: tokenise, pair, diff, align, audit."""
