"""Text hygiene on streams."""
