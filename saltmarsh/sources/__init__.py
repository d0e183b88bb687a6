"""sources of the listings ledger."""
