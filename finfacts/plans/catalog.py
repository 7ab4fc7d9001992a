"""All queries of the library, by name, and their SQL."""

from . import claims, coverage, documents, extras, filings, finance, packets, quality, reads, retrieval, searching, stewardship, submitted

MODULES = (claims, coverage, documents, extras, filings, finance, packets, quality, reads, retrieval, searching, stewardship, submitted)  # each registers its queries with finance's
QUERIES = dict(finance.QUERIES)
ORACLES = dict(finance.ORACLES)
