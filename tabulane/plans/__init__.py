"""Recipes and generated tables: several operators put together."""
