"""Operators for preparing training text at scale. Nothing else in windgrid imports this subpackage."""
