"""A training corpus from raw documents, stage by stage: see corpusmill/llm/pipeline.py.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir).
``run(spark, sf_dir)`` applies them to ``documents``.
"""

from corpusmill.llm.pipeline import ORACLE_SQL, STAGES, mixture, near_duplicates, pieces, quality_classifier, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "mixture", "near_duplicates", "pieces", "quality_classifier", "quality_rules", "run"]
