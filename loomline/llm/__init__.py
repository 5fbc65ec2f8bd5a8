"""Training-data operators: each module holds one operator and its general interface.

``queries`` binds them to the tables; nothing outside this package imports it but
``corpus_pipeline`` and the registration in ``__spark_entry__``.
"""
