"""Readers: files, manifests, human documents, federated texts."""
