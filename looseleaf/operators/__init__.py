"""Relational and text operators: plain functions over DataFrames and Columns."""
