"""Queries over sources and streams: county bundles, subscriptions with a grace period, rate limits as they come."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import county
from ..sources.stage import shared_folder
from ..streaming import timers
from . import views
from .catalogue import query

STATES = {"purchase": "ACTIVE", "error": timers.FAILED, "signup": "TRIALING"}
GRACE_DAYS = 2


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/noticeloom/{uuid.uuid4().hex}/{name}"


def finished(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream tells of what is there now, written by one query and read back."""
    spark = stream.sparkSession
    path = _folder(spark, name)
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _bundles(spark, d) -> str:
    """Documents as bundles: text files whose pages begin with the document's number, form feeds between."""
    docs = views.dealt(views.table(spark, d, "documents").select("doc_id", "text"))
    path = _folder(spark, "bundles")
    docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" ")))).write.option("lineSep", county.PAGE_END).text(path)
    county.register(spark)
    return path


def _told(pages: DataFrame) -> DataFrame:
    cut = F.instr("text", "\n")
    return pages.select(F.substring("text", F.lit(1), cut - 1).cast("long").alias("doc_id"), V.content_hash(F.expr("substring(text, instr(text, '\n') + 1)")).alias("sha256"))


PAGES_SQL = "SELECT doc_id, sha256(replace(coalesce(text, ''), chr(12), ' ')) AS sha256 FROM documents"


@query(PAGES_SQL)
def county_notices(spark, d):
    """Bundles through the data source, a partition each."""
    return _told(spark.read.format("county_notices").load(_bundles(spark, d)))


@query(PAGES_SQL)
def county_notices_stream(spark, d):
    """The same bundles as a stream that ends with what is there."""
    return _told(finished(spark.readStream.format("county_notices").load(_bundles(spark, d)), "pages"))


CHANGES_SQL = f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_id, CASE event_type WHEN 'purchase' THEN 'ACTIVE' WHEN 'error' THEN 'PAST_DUE' WHEN 'signup' THEN 'TRIALING' END AS state FROM events WHERE ts IS NOT NULL),
    n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next, t + {GRACE_DAYS} * 86400000 AS ends FROM e WHERE state IS NOT NULL)
    SELECT user_id, state, t AS at_ms FROM n UNION ALL SELECT user_id, 'EXPIRED', ends FROM n WHERE state = 'PAST_DUE' AND (ends < next OR (next IS NULL AND ends <= (SELECT max(t) FROM e)))"""


def _changes(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("user_id"), "state", F.unix_millis("at").alias("at_ms"))


@query(CHANGES_SQL)
def subscription_changes(spark, d):
    return _changes(timers.subscription_changes(views.table(spark, d, "events"), "user_id", "ts", "event_id", STATES, GRACE_DAYS))


def _events_stream(spark, d) -> DataFrame:
    """The events as arrivals in a folder, which a stream watches."""
    table = views.table(spark, d, "events")
    table.write.parquet(path := _folder(spark, "arrivals"))
    return spark.readStream.schema(table.schema).parquet(path)


@query(CHANGES_SQL)
def subscription_stream(spark, d):
    """States and timers as a stream; grace periods end without a later event of their user."""
    stream = _events_stream(spark, d)
    return _changes(finished(timers.subscription_stream(stream, "user_id", "ts", "event_id", STATES, GRACE_DAYS), "changes"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, t AS opened, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - r.opened >= 3600 THEN e.t ELSE r.opened END, CASE WHEN e.t - r.opened >= 3600 THEN 1 ELSE r.n + 1 END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, user_id, n <= 3 AS allowed FROM r""")
def event_rate_limit_stream(spark, d):
    out = finished(timers.rate_limited_stream(_events_stream(spark, d), "user_id", "ts", "event_id", 3600.0, 3), "hits")
    return out.select("event_id", F.col("key").alias("user_id"), "allowed")
