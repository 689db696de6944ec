"""Whole queries: the derived ledger, the audit, and the registered queries with their SQL."""
