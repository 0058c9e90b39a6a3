"""Operators on tables of JSON documents."""
