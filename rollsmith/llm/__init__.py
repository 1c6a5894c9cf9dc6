"""Operators of a training-data pipeline over text, chat, page and vector tables.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; ``queries`` registers one thin query for each.
"""
