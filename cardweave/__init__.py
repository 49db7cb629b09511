"""Contact-record extraction on Spark: token tables in, clean contact records out."""
