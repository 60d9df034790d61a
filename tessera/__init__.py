"""Document analytics on Spark: lazy DataFrame-to-DataFrame operators."""
