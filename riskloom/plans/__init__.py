"""Registered end-to-end queries (``catalog``) and fixture views."""
