"""Document evidence analytics on Spark: evidence tables in, verdict tables out."""
