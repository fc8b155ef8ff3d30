"""Process-monitoring analytics on Spark DataFrames.

Every table is keyed by ``(episode, raw_index)``: the row order of a sensor
recording is data, never a side effect of how Spark happened to partition it.
"""
