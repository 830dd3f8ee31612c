"""Buffers from bytes and columns, and back."""
