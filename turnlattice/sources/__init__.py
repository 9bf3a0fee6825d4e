"""Readers and writers of the fixed binary formats, reports, and the run ledger."""
