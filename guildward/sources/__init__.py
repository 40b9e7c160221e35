"""Readers of wordlists and lexicon folders, and the mapping of event tables to messages."""
