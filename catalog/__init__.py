"""Runnable queries, one per operator, each with the same question in plain SQL where SQL can ask it."""
