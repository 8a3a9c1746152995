"""Tables of the archive."""
