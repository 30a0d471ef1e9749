"""Training-data operators: text and page processing at corpus scale.

Nothing outside this subpackage imports it.
"""
