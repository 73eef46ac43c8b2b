"""Event-time forms of the ordered-stream operators."""
