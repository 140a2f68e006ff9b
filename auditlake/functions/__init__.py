"""Expression builders.

The functions take and return Spark SQL expressions as text.  A text is parsed
in one step, where a chain of Column calls would cost a round trip to the JVM
per call; the resulting plans are the same.  Nothing here runs Python per row.
"""
