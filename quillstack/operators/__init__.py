"""Operators over documents, blocks, positions, highlights and bundles."""
