"""Operators on bars, actions, breadth, screens, news and stored tables."""
