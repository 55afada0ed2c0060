"""Training-data operations on Spark DataFrames.

Nothing else in the library imports this subpackage.  Each module holds one
operation with a general interface; :mod:`beaconfold.llm.queries` applies them
to whole tables with production parameters.
"""
