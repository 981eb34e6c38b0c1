"""Training-data operators: search, near-duplicate joins, packing, chat
formatting, byte-level BPE, PII, secrets, sharding, quality and exact top-k.

Nothing else in the library imports this subpackage; ``queries`` registers
one ``opN_<name>`` query per operator.
"""
