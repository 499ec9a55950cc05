"""Queries; importing a module registers its own."""
