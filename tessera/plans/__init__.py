"""Queries over the driver's tables; importing the modules registers them."""
