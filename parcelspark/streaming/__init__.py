"""Event-time windows and change capture."""
