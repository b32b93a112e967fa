"""Streams: a general capability of Spark; the surveyed operators are all batch."""
