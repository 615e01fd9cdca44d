"""Schemas, generated and derived inputs, and the versioned store."""
