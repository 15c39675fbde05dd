"""Linkage schemas: fields, JSON forms and their rules, and the registered queries."""
