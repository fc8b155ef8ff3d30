"""Readers, declared data cards, manifests and sinks."""
