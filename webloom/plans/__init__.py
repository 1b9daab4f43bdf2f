"""plans of the web-corpus engine."""
