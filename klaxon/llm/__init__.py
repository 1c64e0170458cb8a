"""Operators for preparing training text at scale: filters, de-duplication, search, packing and archives."""
