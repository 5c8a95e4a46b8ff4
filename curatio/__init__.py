"""curatio: Spark DataFrame stages for curating long-term multi-modal conversation datasets.

Subpackages: ``functions`` (Column expressions, the literal-parse UDF, keyed draws),
``operators`` (dedupe, reports, positions, top-k), ``plans`` (the stages),
``sources`` (readers/writers), ``streaming`` (resumable ingest), ``standins``
(driver queries over the test tables).
"""

__version__ = "0.1.0"
