"""Registered queries, each with independent SQL for the same answer."""
