"""Composed jobs and fixtures."""
