"""Functions over whole schemas."""
