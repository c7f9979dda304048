"""Training-data operators: deduplication, token counts, quality, chat, secrets, leaks, language, mixing.

Nothing outside this subpackage imports it.
"""
