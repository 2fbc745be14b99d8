"""Readers, sinks, manifests and checksums."""
