"""DataFrame operators over the code graph."""
