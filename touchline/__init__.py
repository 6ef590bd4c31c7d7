"""touchline: web-analytics traffic-source and attribution jobs on Spark.

Every public job of `plans` is a function from DataFrame(s) to a DataFrame built
from native Spark SQL expressions, aggregates, windows and joins; nothing runs
an action, and no Python UDF sits on a row path.

Layout:
    sources/    reading an export (date-partitioned) and the test-table adapter
    functions/  column-level helpers: event parameters, time math, channels
    operators/  reusable relational building blocks (skew-safe as-of fill)
    plans/      the user-level jobs: sessions, attribution, lookback, channels
    llm/        operators of a training-data pipeline (nothing else imports it)
"""

from touchline.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
