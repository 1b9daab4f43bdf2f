"""functions of the web-corpus engine."""
