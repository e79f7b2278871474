"""Operators for preparing training text: repetition, near copies, quality, page furniture, markup,
split overlap, packing, mixing and personal data.

Nothing outside this subpackage imports it; it imports nothing of the library but ``corpusmill.durable``.
"""
