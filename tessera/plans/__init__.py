"""Importing the package's catalogue registers every query."""
