"""Registered queries; importing the modules fills the registry."""
