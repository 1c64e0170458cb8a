"""Adapters from tables, queues and scraped documents to records."""
