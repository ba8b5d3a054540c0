"""Fitted preparation on a stream."""
