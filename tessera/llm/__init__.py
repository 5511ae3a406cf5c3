"""Training-data operators: scoring, de-duplication, fingerprints, token files, packing, mixing and search.

Nothing outside this subpackage imports it; its queries are in ``tessera.llm.queries``."""
