"""Training-data operators: ten corpus-scale components, one module each.

Nothing outside this subpackage imports it; its queries and oracle SQL live in
``folianta.llm.entry``.
"""
