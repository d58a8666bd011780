"""Tessera: a PySpark-native retrieval-analytics engine.

Every public function takes and returns DataFrames and stays lazy unless its
docstring says that it writes an intermediate table.
"""
