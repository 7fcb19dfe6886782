"""Environs: scoring places by what surrounds them, as PySpark DataFrame plans."""
