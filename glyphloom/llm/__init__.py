"""Training-data operators over whole corpora; nothing else in the library imports them."""
