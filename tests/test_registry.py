"""One pass over sessions: projects by remote or path, aliases of checkouts, and the same result on a second pass."""

from pyspark.sql import functions as F

from palimpsest.operators import registry as R

LO, HI = R.ALWAYS
SESSION = "session_id long, machine string, provider string, cwd string, project string, remote string, start_us long"
ALIAS = "id long, project_key string, machine string, prefix string, provider string, alias string, from_us long, to_us long"
PROJECT = "project_key string, name string, is_unresolved boolean, " + ", ".join(f"{c} string" for c in R.PLACE.values())


def made(spark, sessions, projects=(), aliases=(), now=0):
    return R.rebuild_registry(spark.createDataFrame(list(sessions), SESSION), spark.createDataFrame(list(projects), PROJECT), spark.createDataFrame(list(aliases), ALIAS), now)


def names(reg):
    """session_id to its project's name."""
    return {r.session_id: r["name"] for r in reg.sessions.join(reg.projects, "project_key", "left").collect()}


def session(k, cwd=None, remote=None, provider="chat", machine="m", project=None, us=5):
    return (k, machine, provider, cwd, project, remote, us)


def alias(k, key, prefix, machine=None, provider=None, lo=LO, hi=HI):
    return (k, key, machine, prefix, provider, prefix, lo, hi)


def project(key, name, unresolved=True, url=None):
    return (key, name, unresolved, url, None, None, None)


def rows(frame):
    return sorted(map(repr, (tuple(r) for r in frame.select(*sorted(frame.columns)).collect())))


def test_remotes_paths_and_nothing(spark):
    reg = made(spark, [session(1, "/a/B/", "git@Host:Own/Repo.git"), session(2, "c:\\x\\\\y\\"), session(3), session(4, "   "), session(5, "", project="/q/w"), session(6, "/", "no remote"), session(7, "/z/.", ""), session(8, "/A/b")])
    assert names(reg) == {1: "repo", 2: "y", 3: "Unallocated", 4: "Unallocated", 5: "w", 6: "/", 7: "z", 8: "b"}
    known = {r["name"]: r for r in reg.projects.collect()}
    assert (known["repo"].repository_url, known["repo"].is_unresolved) == ("https://host/own/repo", False)
    assert known["y"].is_unresolved and known["y"].repository_url is None
    assert reg.projects.filter(F.col("name") == "Unallocated").count() == 1
    assert {r.prefix for r in reg.aliases.collect()} == {"/a/B", "/c:/x/y", "/q/w", "/", "/z/.", "/A/b"}


def test_a_checkout_leads_sessions_of_every_provider_below_it(spark):
    reg = made(spark, [session(1, "/w/app", "https://h/o/app", "git"), session(2, "/w/app/src"), session(3, "/w/application"), session(4, "/w/app", machine="other"), session(5, "/w/app", provider="git")])
    assert names(reg) == {1: "app", 2: "app", 3: "application", 4: "app", 5: "app"}
    urls = {r.session_id: r.repository_url for r in reg.sessions.join(reg.projects, "project_key").collect()}
    assert urls == {1: "https://h/o/app", 2: "https://h/o/app", 3: None, 4: None, 5: "https://h/o/app"}
    assert {(r.prefix, r.provider) for r in reg.aliases.filter("machine = 'm'").collect()} == {("/w/app", None), ("/w/app/src", "chat"), ("/w/application", "chat")}


def test_the_most_specific_alias_in_force(spark):
    known = [alias(1, "any", "/p"), alias(2, "long", "/p/q"), alias(3, "mine", "/p", machine="m"), alias(4, "chat", "/p", provider="chat"), alias(5, "past", "/p/q/r", hi=5), alias(6, "twin", "/p/q"), (7, "null", None, None, None, "x", LO, HI)]
    own = [project(k, k) for k in ("any", "long", "mine", "chat", "past", "twin", "null")]
    reg = made(spark, [session(1, "/p/q/r"), session(2, "/p/q/r", machine="n"), session(3, "/p/q/r", machine="n", provider="x"), session(4, "/p/q/r", machine="n", provider="x", us=4), session(5, "/p/q/r", machine=None, provider="x", us=None), session(6, "/P", "https://h/o/r")], own, known, now=4)
    assert names(reg) == {1: "mine", 2: "chat", 3: "twin", 4: "past", 5: "past", 6: "r"}
    assert {r["name"] for r in reg.projects.collect()} == {*(k for k, *_ in own), "r"}


def test_known_projects_are_renamed_completed_and_never_unresolved_again(spark):
    first = made(spark, [session(1, "/a", "https://h/o/r"), session(2, "/b")])
    keys = {r["name"]: r.project_key for r in first.projects.collect()}
    old = [project(keys["r"], "old", False, "https://old"), project(keys["b"], "old", False), project("k", "kept")]
    got = {r.project_key: (r["name"], r.repository_url, r.is_unresolved) for r in made(spark, [session(9, "/a", "https://h/o/r"), session(3, "/b")], old).projects.collect()}
    assert got == {keys["r"]: ("r", "https://h/o/r", False), keys["b"]: ("b", None, False), "k": ("kept", None, True)}


def test_a_second_pass_changes_nothing(spark):
    sessions = [session(k, f"/w/p{k % 7}/{'sub' if k % 3 else ''}", f"https://h/o/p{k % 7}" if k % 4 == 0 else None, "git" if k % 4 == 0 else "chat", f"m{k % 2}") for k in range(60)] + [session(100, "/archive/imported"), session(101)]
    one = made(spark, sessions)
    two = R.rebuild_registry(spark.createDataFrame(sessions, SESSION), one.projects, one.aliases, 0)
    assert rows(two.projects) == rows(one.projects) and rows(two.aliases) == rows(one.aliases) and rows(two.sessions) == rows(one.sessions)
    assert one.aliases.count() == one.aliases.select(*R.ALIAS).distinct().count()
    assert one.sessions.filter("project_key is null").count() == 0 and one.sessions.count() == len(sessions)


def test_empty_tables(spark):
    reg = made(spark, [])
    assert (reg.projects.count(), reg.aliases.count(), reg.sessions.count()) == (0, 0, 0)
