"""Training-data operators: one module each, plus their registered queries in ``queries``.

Nothing outside this subpackage imports it.
"""
