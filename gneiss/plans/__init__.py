"""Registered queries over the canonical tables, each with its oracle. Importing a module registers its queries."""
