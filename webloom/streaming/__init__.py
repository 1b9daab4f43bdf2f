"""streaming of the web-corpus engine."""
