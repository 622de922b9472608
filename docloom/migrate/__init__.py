"""Migrations of a database of collections, typed stores and instances of models."""
