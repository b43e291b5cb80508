"""Spark-native analytics on how web publishers control the use of their content.

Every operator takes DataFrames and returns a DataFrame; nothing runs on the
driver but plan building.  See README.md for the map from task to module.
"""
