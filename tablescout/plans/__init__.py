"""Query strings and their execution."""
