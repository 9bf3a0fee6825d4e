"""Relational operators: the dice universe, reachable states, actions, statistics, estimands."""
