"""Change feeds and event streams."""
