"""Expressions, lookup tables and the few Arrow functions the expressions cannot replace."""
