"""operators of the listings ledger."""
