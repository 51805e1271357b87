"""Operators that prepare training text at corpus scale: near-duplicates, search, filters, tokens, packing, chats.

Nothing else in the library imports this subpackage.
"""
