"""Predicates, subscriptions and renderings as Spark columns."""
