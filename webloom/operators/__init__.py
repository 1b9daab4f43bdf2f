"""operators of the web-corpus engine."""
