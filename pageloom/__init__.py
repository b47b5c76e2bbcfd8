"""pageloom: web-article corpus processing on PySpark.

Pages become typed article blocks, blocks become reading units, and reader
events become progress tables, all as DataFrame and Structured Streaming jobs.
"""
