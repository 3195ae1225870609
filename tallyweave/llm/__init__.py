"""Operators on text collections: documents, web pages and conversations.

Nothing outside this folder imports it. ``registry`` holds the queries and their check SQL.
"""
