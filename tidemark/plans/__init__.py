"""Composed queries behind dashboards and exports."""
