"""Logical plans shared by several operators."""
