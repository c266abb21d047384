"""Readers: source trees, manifests, protocol files, git history, symbol indexes and bundles."""
