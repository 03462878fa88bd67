"""Sources: files by lane, document parsers, web captures."""
