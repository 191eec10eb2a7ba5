"""incidentlab: enrichment and classification of geo-temporal incident records
on Spark (DataFrame/SQL/ML), with native Column expressions throughout."""

__version__ = "0.1.0"
