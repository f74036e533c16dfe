"""DataFrame -> DataFrame operators over pages, tokens, entries, lines and receipts."""
