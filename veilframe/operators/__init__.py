"""Governance operators: recognizers, policy, classification, rewriting, alerts."""
