"""Models: predicates, rules and nodes; and the planner that turns them into one DataFrame."""
