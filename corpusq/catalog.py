"""All registered queries of the library's own operators, and their SQL."""

from corpusq import queries_answers, queries_files, queries_logs, queries_text  # noqa: F401  each adds its queries
from corpusq.queries import QUERIES, SQL  # noqa: F401
