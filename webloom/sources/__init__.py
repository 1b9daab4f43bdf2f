"""sources of the web-corpus engine."""
