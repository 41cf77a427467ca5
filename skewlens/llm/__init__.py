"""Operators for preparing training data; see the README of the package for the list."""
