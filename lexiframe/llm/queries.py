"""The queries of this subpackage: name -> (function of session and folder, DuckDB SQL or None)."""

from . import (bpe, collocations, decontaminate, exact_dedup, html_main, license_scan, near_dedup, secret_scan, sharding, suffix_dedup,
               token_align, toxicity, warc)

MODULES = [toxicity, html_main, secret_scan, exact_dedup, decontaminate, warc, near_dedup, sharding, suffix_dedup, bpe,
           license_scan, collocations, token_align]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
