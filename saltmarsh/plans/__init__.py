"""plans of the listings ledger."""
