"""Smoothers over DataFrames and the NumPy core they share."""
