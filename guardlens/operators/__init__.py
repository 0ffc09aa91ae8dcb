"""Checks, guards, mining, diagnosis and evaluation operators."""
