"""Column helpers and plan-time scalar functions."""
