"""Keeps warehouse tables in step with a business system's entities, checks them, and reports on them, all in Spark."""
