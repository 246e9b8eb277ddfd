"""Query catalogue over the driver tables (see ``catalog`` and ``oracle``)."""
