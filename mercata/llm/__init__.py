"""Operators of a training-data pipeline over text, pages, vectors and chats.

Nothing else in the library imports this subpackage.
"""
