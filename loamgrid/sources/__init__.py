"""Where tables go to: replacement by key, and files for people."""
