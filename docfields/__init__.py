"""docfields: Spark jobs for digitised paper forms.

Every operator takes DataFrames and returns DataFrames. Sub-packages:

* ``sources``    readers and writers (tables, templates, detections, images, progress events)
* ``functions``  column expressions and the few reusable distributed building blocks
* ``operators``  filters, joins, reports, standardisation, layout, merging, lifecycle
* ``plans``      multi-step jobs composed from operators
* ``streaming``  Structured Streaming forms of the same jobs
* ``catalog``    the registered queries with their SQL counterparts
"""

__version__ = "0.1.0"
