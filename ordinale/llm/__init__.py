"""Training-data operators: ten scans, joins and packers over text tables.

The rest of the library never imports this package; ``__spark_entry__``
registers its queries only when it can be imported.
"""
