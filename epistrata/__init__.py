"""epistrata: a PySpark engine for episodic time series and the corpora around them.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (DataFrame to DataFrame), ``plans`` (whole queries and their SQL twins),
``streaming`` (Structured Streaming operators). ``llm`` is optional; nothing else imports it.
"""

__version__ = "0.1.0"
