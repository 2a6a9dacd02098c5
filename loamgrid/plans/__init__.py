"""Session settings and durable intermediate tables."""
