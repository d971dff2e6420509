"""Smoothers on Structured Streaming."""
