"""Spark-native operators for long-running sensor networks.

Every operator takes DataFrames and returns a DataFrame.  Series are *tall*: one
row per ``(sensor, rn)``, where ``rn`` is the zero-based position of the reading
in its sensor's history.  Missing data is ``NULL``, never ``NaN``.
"""
