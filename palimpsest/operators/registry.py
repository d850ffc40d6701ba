"""Attribution: most specific prefix rules, lineage roots and unresolved rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import identity, text as X
from palimpsest.operators.intervals import as_of
from palimpsest.session import checkpoint


def most_specific(rows: DataFrame, rules: DataFrame, path: str, at: str, out: str, *, optional: list[str] = ()) -> DataFrame:
    """The most specific prefix rule of the path that holds at the time: rule columns (prefix, from_us, to_us, out).

    A prefix fits whole segments.  Rules are joined by each of the path's own
    prefixes, so the join is an equi-join whatever the number of rules.  Rules may
    name a value for each of ``optional`` columns, or null for any; a rule that
    names the first of them comes before one that does not, and so on; then the
    longer prefix, the later start and the greater ``id`` win.
    """
    own = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return _best(own.withColumn("_p", F.explode_outer(prefixes)), rows.columns, rules, at, out, list(optional), list(optional))


def contributor_of(rows: DataFrame, rules: DataFrame, path: str, at: str, out: str, *, machine: str = "machine", provider: str = "provider") -> DataFrame:
    """The contributor rule of a row's machine: provider or null, and any leading characters of the path or null.

    Of those in force the longest prefix wins, then the later start, then the
    greater id.  Rows are joined by their leading characters of those lengths that
    rules have, as an equi-join; there are no more lengths than a path has characters.
    """
    own = rows.withColumn("_row", F.monotonically_increasing_id())
    none = rows.sparkSession.range(1).select(F.lit(0).alias("_n"))  # so that every row stays, whatever its path
    lengths = rules.select(F.length(F.coalesce("prefix", F.lit(""))).alias("_n")).union(none).distinct()
    led = own.crossJoin(F.broadcast(lengths)).filter((F.length(path) >= F.col("_n")) | (F.col("_n") == 0)).withColumn("_p", F.left(F.coalesce(F.col(path), F.lit("")), F.col("_n"))).drop("_n")
    return _best(led, rows.columns, rules.filter(F.col(machine).isNotNull()), at, out, [machine, provider], [])


def _best(led: DataFrame, columns: list[str], rules: DataFrame, at: str, out: str, optional: list[str], ordered: list[str]) -> DataFrame:
    """Each row (``_row``; once for each of its prefixes ``_p``) with its best rule's value; numbers of rows are read once, so they may differ after a retry."""
    identity = F.col("id") if "id" in rules.columns else F.lit(0)
    r = rules.select(F.coalesce("prefix", F.lit("")).alias("_q"), F.col("from_us").alias("_from"), F.col("to_us").alias("_to"), F.col(out).alias("_v"), identity.alias("_id"), *(F.col(c).alias(f"_{c}") for c in optional))
    on = (F.col("_p") == F.col("_q")) & (F.col("_from") <= F.col(at)) & (F.col(at) < F.col("_to"))
    for c in optional:
        on = on & (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
    w = Window.partitionBy("_row").orderBy(F.desc(F.col("_q").isNotNull()), *(F.desc(F.col(f"_{c}").isNotNull()) for c in ordered), F.desc(F.length("_q")), F.desc("_from"), F.desc("_id"), "_v")
    best = led.join(r, on, "left").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return best.select(*columns, F.col("_v").alias(out))


def first_override(rows: DataFrame, linked: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Rows with the values of their key's first linked override in order, or nulls."""
    first = linked.groupBy(key).agg(F.min(F.struct(order, *values)).alias("_o"))
    return rows.join(first, key, "left").select(*rows.columns, *(F.col(f"_o.{v}").alias(v) for v in values))


def activity_of(slices: DataFrame, overrides: DataFrame, defaults: DataFrame, key: str, project: str, at: str) -> DataFrame:
    """``activity`` and ``ambiguous``: the one activity that overrides a slice; none if several do; else the project's default at the time."""
    own = overrides.groupBy(key).agg(F.countDistinct("activity").alias("_n"), F.min("activity").alias("_one"))
    dated = as_of(slices, defaults, [project], at, "activity").withColumnRenamed("activity", "_default")
    out = dated.join(own, key, "left")
    return out.withColumn("activity", F.when(F.col("_n") == 1, F.col("_one")).when(F.coalesce("_n", F.lit(0)) == 0, F.col("_default"))).withColumn("ambiguous", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n", "_one", "_default")


def work_trail(episodes: DataFrame, overrides: DataFrame, defaults: DataFrame, kinds: DataFrame, *, limit: int) -> DataFrame:
    """The newest episodes with their activity and its classification (a report of ``limit`` rows)."""
    newest = episodes.orderBy(F.desc_nulls_last("start_us"), F.desc("session_id")).limit(limit)
    dated = as_of(newest, defaults, ["project_id"], "start_us", "activity").withColumnRenamed("activity", "_default")
    named = dated.join(overrides, "session_id", "left").withColumn("activity", F.coalesce("activity", "_default"))
    return named.join(kinds, "activity", "left").withColumn("classification", F.coalesce("classification", F.lit("unclassified")))


def related(identities: DataFrame, touched: DataFrame, same: list[str], owner: str) -> DataFrame:
    """Owners that share an identity with a touched one, themselves included."""
    return identities.join(touched.select(*same).distinct(), same, "left_semi").select(owner).distinct()


def member_faults(rows: DataFrame, member: str, owner: str) -> DataFrame:
    """Members that more than one owner has, with the number of ``owners``; empty if each has one."""
    return rows.groupBy(member).agg(F.countDistinct(owner).alias("owners")).filter("owners > 1")


def dimension(rows: DataFrame, key: str, columns: dict[str, Column], *, fallback: str) -> DataFrame:
    """A dimension from the facts that mention it, and the row that unallocated facts go to."""
    found = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*(c.alias(n) for n, c in columns.items()))
    rest = rows.sparkSession.range(1).select(F.lit(fallback).alias(key), *(F.lit(None).cast(found.schema[n].dataType).alias(n) for n in columns))
    return found.unionByName(rest.join(found.select(key), key, "left_anti"))


def lineage_roots(edges: DataFrame) -> DataFrame:
    """(id, parent_id) to (id, root_id) by pointer doubling; a missing parent or none makes a row its own root.

    Each round doubles the distance, so a chain takes its logarithm in rounds.  As
    long as a chain is open, a round brings some row to its root; once none gets
    there and no least id falls, the rows that are left are on cycles, or behind
    one, and have the least id that they reach.
    """

    def state(p: DataFrame) -> tuple:
        return tuple(p.filter("not rooted").agg(F.count("*"), F.sum(F.col("least").cast("decimal(38,0)"))).first())

    known = edges.select(F.col("id").alias("_k"))
    up = F.coalesce("_k", "id")
    parents = checkpoint(edges.join(known, F.col("parent_id") == F.col("_k"), "left").select("id", up.alias("to"), F.least("id", up).alias("least"), (F.col("id") == up).alias("rooted")))
    before, now = None, state(parents)
    while now[0] and now != before:
        hop = parents.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("rooted").alias("_rooted"))
        parents = checkpoint(parents.join(hop, "to").select("id", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), F.col("_rooted").alias("rooted")))
        before, now = now, state(parents)
    return parents.select("id", F.when(F.col("rooted"), F.col("to")).otherwise(F.col("least")).alias("root_id"))


def unresolved(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null or not in the dimension."""
    return rows.join(dim.select(key).distinct(), key, "left_anti")


def round_robin(rows: DataFrame, bucket: str, recency: str, tie: str, *, per_bucket: int, limit: int) -> DataFrame:
    """Depth-first selection over buckets by recency: first of each bucket, then second, and so on (a limit of the report)."""
    w = Window.partitionBy(bucket).orderBy(F.desc_nulls_last(recency), tie)
    deep = rows.withColumn("depth", F.row_number().over(w)).filter(F.col("depth") <= per_bucket)
    newest = deep.groupBy(bucket).agg(F.max(recency).alias("_newest"))
    return deep.join(newest, bucket).orderBy("depth", F.desc_nulls_last("_newest"), bucket).limit(limit).drop("_newest")


#: The range in force of an alias that nobody has dated.
ALWAYS = (-(1 << 63), (1 << 63) - 1)
PLACE = {"url": "repository_url", "host": "repository_host", "owner": "repository_owner", "repository": "repository_name"}
ALIAS = ["project_key", "machine", "prefix", "provider", "from_us"]


class Registry(NamedTuple):
    """Projects (by ``project_key``), aliases of paths, and the project of each session."""

    projects: DataFrame
    aliases: DataFrame
    sessions: DataFrame


def rooted(path: Column) -> Column:
    """The path from the root with forward slashes and no empty part; null if it is null or blank."""
    parts = F.filter(F.split(F.replace(X.strip(path), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.when(X.strip(path) != "", F.concat(F.lit("/"), F.array_join(parts, "/")))


def named_project(sessions: DataFrame) -> DataFrame:
    """Sessions with the project that their own ``remote``, else their own path, names.

    A remote that reads as host, owner and repository gives a resolved project of
    that key; a path (``cwd``, or ``project`` where that is empty) gives an
    unresolved one, named by its leaf; neither gives ``Unallocated``.  Keys tell no
    case apart.
    """
    raw = X.strip(F.coalesce(F.when(F.col("cwd") != "", F.col("cwd")), F.col("project")))
    parts = F.filter(F.split("prefix", "/"), lambda p: ~p.isin("", "."))
    found = sessions.withColumns({"raw_path": F.when(raw != "", raw), "prefix": rooted(raw), "_place": X.git_remote(F.col("remote"))})
    by_remote = identity.key(F.lit("git"), F.col("_place.host"), F.col("_place.owner"), F.col("_place.repository"))
    by_path = identity.key(F.lit("path"), F.lower("prefix"))
    own = {
        "project_key": F.coalesce(by_remote, by_path, identity.key(F.lit("project"), F.lit("unallocated"))),
        "name": F.coalesce("_place.repository", F.try_element_at(parts, F.lit(-1)), "prefix", F.lit("Unallocated")),
        "is_unresolved": F.col("_place").isNull(),
    }
    return found.withColumns(own | {n: F.col(f"_place.{f}") for f, n in PLACE.items()}).drop("_place")


def _new_aliases(found: DataFrame, known: DataFrame) -> DataFrame:
    """Undated aliases that no known one has the identity of (nulls are equal); the least spelling of each."""
    fresh = found.withColumns({"from_us": F.lit(ALWAYS[0]), "to_us": F.lit(ALWAYS[1])}).groupBy(*ALIAS, "to_us").agg(F.min("raw_path").alias("alias"))
    k = known.select(*(F.col(c).alias(f"_{c}") for c in ALIAS))
    return fresh.join(k, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ALIAS], "left_anti").withColumn("id", F.lit(ALWAYS[1]))


def rebuild_registry(sessions: DataFrame, projects: DataFrame, aliases: DataFrame, now_us: int) -> Registry:
    """The registry after a pass over all sessions (session_id, machine, provider, cwd, project, remote, start_us).

    ``projects``: project_key, name, the four of ``PLACE``, is_unresolved.
    ``aliases``: id, project_key, machine, prefix, provider, alias, from_us, to_us; a
    null machine or provider fits any, a null prefix none.

    A project is added, or renamed by its first session, unless all its sessions have
    no remote and a path that an alias in force covers; it keeps what it knows of its
    remote, and stays unresolved only if both say so.  Then checkouts (sessions of
    ``git`` with a remote) become aliases for every provider, sessions without a
    remote go to the most specific alias of their path, and all paths become aliases.
    Sessions without a start are judged at ``now_us``.  New aliases come after all
    others in ties.  A second pass over its own result changes nothing but what later
    aliases let it resolve.  Sessions of one project are combined before the shuffle.
    """
    staged = named_project(sessions.select("session_id", "machine", "provider", "cwd", "project", "remote", "start_us")).withColumn("_at", F.coalesce("start_us", F.lit(now_us)))
    loose = F.col("repository_url").isNull() & F.col("prefix").isNotNull()

    def fitting(known: DataFrame) -> DataFrame:
        rules = known.filter(F.col("prefix").isNotNull()).withColumnRenamed("project_key", "aliased")
        return most_specific(staged.filter(loose), rules, "prefix", "_at", "aliased", optional=["machine", "provider"])

    shape = ["name", *PLACE.values(), "is_unresolved"]
    named = staged.filter(~loose).unionByName(fitting(aliases).filter("aliased is null").drop("aliased"))
    first = named.groupBy("project_key").agg(F.min_by(F.struct(*shape), "session_id").alias("_new"))
    both = projects.select("project_key", F.struct(*shape).alias("_old")).join(first, "project_key", "full")
    unresolved_both = F.coalesce("_old.is_unresolved", F.lit(True)) & F.coalesce("_new.is_unresolved", F.lit(True))
    merged = both.select("project_key", *(F.coalesce(f"_new.{c}", f"_old.{c}").alias(c) for c in shape[:-1]), unresolved_both.alias("is_unresolved"))

    columns = [*ALIAS, "to_us", "alias", "id"]
    checkouts = staged.filter((F.col("provider") == "git") & F.col("repository_url").isNotNull() & F.col("prefix").isNotNull()).withColumn("provider", F.lit(None).cast("string"))
    known = aliases.select(*columns).unionByName(_new_aliases(checkouts, aliases).select(*columns))
    resolved = staged.filter(~loose).withColumn("aliased", F.lit(None).cast("string")).unionByName(fitting(known))
    resolved = resolved.withColumn("project_key", F.coalesce("aliased", "project_key"))
    seen = resolved.filter(F.col("prefix").isNotNull()).withColumn("provider", F.when(F.col("provider") != "git", F.col("provider")))
    return Registry(merged, known.unionByName(_new_aliases(seen, known).select(*columns)), resolved.select("session_id", "project_key"))
