"""Queries and whole evaluations composed of operators."""
