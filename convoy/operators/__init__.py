"""Operators over message, ticket, category, usage and metric tables."""
