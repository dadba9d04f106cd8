"""Edit logs as streams."""
