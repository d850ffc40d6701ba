"""Detail reads: lists of sessions and episodes, and single events and episodes with all that belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators import lexicon

#: Most rows of a list.
LIST = 500


def _page(rows: DataFrame, order: list[Column], limit: int, offset: int, most: int = LIST) -> DataFrame:
    """Rows at the places offset + 1 to offset + limit, with their ``position``; only those up to there are ranked."""
    limit, offset = min(max(limit, 1), most), max(offset, 0)
    best = rows.orderBy(*order).limit(offset + limit)
    return best.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).filter(F.col("position") > offset)


def list_sessions(sessions: DataFrame, *, provider: str | None = None, project: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Sessions that ended last first, those without a time last, with their ``position``.

    ``project`` is a project's key or name, ``text`` part of an external id, project, folder
    or title, in any case of letters.  Columns that a table lacks never match.
    """
    def any_of(columns: tuple[str, ...], test) -> Column:
        out = F.lit(False)
        for c in columns:
            if c in sessions.columns:
                out = out | F.coalesce(test(F.col(c)), F.lit(False))
        return out

    found = sessions if provider is None else sessions.filter(F.col("provider") == provider)
    if project is not None:
        found = found.filter(any_of(("project_key", "project_name", "project"), lambda c: c.cast("string") == project))
    if text is not None:
        found = found.filter(any_of(("external_id", "project", "cwd", "title"), lambda c: F.contains(F.lower(c.cast("string")), F.lower(F.lit(text)))))
    return _page(found, [F.desc_nulls_last(F.coalesce("end_us", "start_us")), F.desc("session_id")], limit, offset)


def event_details(events: DataFrame, units: DataFrame, artifacts: DataFrame, ids: DataFrame, *, event: str = "event_id") -> DataFrame:
    """The asked events with ``units`` (in order) and ``artifacts`` as arrays, empty where there are none.

    ``units`` have unit_index, unit_key, kind, label, is_error and text; ``artifacts`` have
    artifact_id, kind, label and value.  An id that no event has gives no row.
    """
    asked = ids.select(event).distinct()
    of_units = units.join(asked, event, "left_semi").groupBy(event).agg(F.sort_array(F.collect_list(F.struct("unit_index", "unit_key", "kind", "label", "is_error", "text", F.length("text").alias("chars")))).alias("units"))
    of_artifacts = artifacts.join(asked, event, "left_semi").groupBy(event).agg(F.sort_array(F.collect_list(F.struct("artifact_id", "kind", "label", "value", F.sha2("value", 256).alias("value_hash")))).alias("artifacts"))
    out = events.join(asked, event, "left_semi").join(of_units, event, "left").join(of_artifacts, event, "left")
    return out.withColumn("units", F.coalesce("units", F.array().cast(of_units.schema["units"].dataType))).withColumn("artifacts", F.coalesce("artifacts", F.array().cast(of_artifacts.schema["artifacts"].dataType)))


def episode_details(episodes: DataFrame, links: DataFrame, events: DataFrame, prints: DataFrame, ids: DataFrame, *, episode: list[str]) -> DataFrame:
    """The asked episodes with their ``events`` by position and their ``fingerprints`` by kind and value."""
    asked = ids.select(*episode).distinct()
    own = links.join(asked, episode, "left_semi").join(events.select("event_id", "us", "kind"), "event_id")
    of_events = own.groupBy(*episode).agg(F.sort_array(F.collect_list(F.struct("position", "section", "event_id", "us", "kind"))).alias("events"))
    of_prints = prints.join(asked, episode, "left_semi").groupBy(*episode).agg(F.sort_array(F.collect_list(F.struct("kind", "value"))).alias("fingerprints"))
    return episodes.join(asked, episode, "left_semi").join(of_events, episode, "left").join(of_prints, episode, "left")


def list_episodes(episodes: DataFrame, queries: DataFrame | None = None, *, key: str = "episode_id", provider: str | None = None, project: str | None = None, state: str | None = None, errors_only: bool = False, limit: int = 100, qkey: str = "query_id", qtext: str = "query") -> DataFrame:
    """Episodes by filters; with queries, those whose document holds all words of a query, by cover density, for each query.

    Ties and lists without a query go by end (or start), latest first, then by key.  Adds
    ``position``, and with queries ``score``.
    """
    found = episodes
    for column, value in (("provider", provider), ("project", project), ("evidence_state", state)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    if errors_only:
        found = found.filter("errors > 0")
    latest = [F.desc_nulls_last(F.coalesce("end_us", "start_us")), F.desc(key)]
    if queries is None:
        return _page(found, latest, limit, 0)
    ends = found.withColumn("_ended", F.coalesce("end_us", "start_us"))
    hit = lexicon.search(ends, queries, key, "document", qkey, qtext, best=min(max(limit, 1), LIST), latest="_ended").select(qkey, key, "score").join(found, key)
    ranked = hit.withColumn("position", F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), *latest)))
    return ranked.filter(F.col("position") <= min(max(limit, 1), LIST))
