"""quarry: rule-based field extraction over document corpora, on Spark.

Files (text, web pages, conversations, workbooks, office packages) become
ordered blocks; a JSON rule set is compiled on the driver into Spark column
expressions and evaluated over the whole corpus in one pass; every result
carries a citation, and every miss is a record of its own.
"""

from quarry.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
