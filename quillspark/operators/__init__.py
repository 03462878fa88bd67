"""DataFrame operators: evidence search, citation checks, consent, retention, publication."""
