"""Training-data operators: filtering, de-duplication, packing and archives at corpus scale.

Nothing outside this subpackage imports it.
"""
