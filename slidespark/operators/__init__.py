"""Operators over pixels (y, x, channel_id, value), vertices and points."""
