"""Change-driven tables on Spark: logs, state, predicates, subscriptions and reducers as DataFrame computations."""
