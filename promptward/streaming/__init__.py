"""The scan and its analytics on streams."""
