"""streaming of the listings ledger."""
