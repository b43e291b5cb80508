"""Pages joined with the policies of their origin (F1 - F11), over a fetch log.

``fetches(url, kind, ts, status, location, content_type, content, error)`` takes the
place of live requests; ``kind`` is ``robots`` or ``tdmrep``.  Contents are parsed
once per fetched file and never take part in the redirect joins.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions import rows
from sitestance.functions import url as u
from sitestance.operators import robots, skew, spans, tdm
from sitestance.session import shared_dir

POLICY_PATHS = {"robots": "/robots.txt", "tdmrep": "/.well-known/tdmrep.json"}


# --- F1 - F4 ------------------------------------------------------------------


def validate(pages: DataFrame) -> DataFrame:
    """blank URLs are dropped; malformed ones stay, with ``error`` set."""
    known = pages.where(F.coalesce(F.btrim("url"), F.lit("")) != "")
    bad = ~F.coalesce(u.is_valid(F.col("url")), F.lit(False))
    return known.withColumn(
        "error", F.when(bad, F.concat(F.col("url"), F.lit(" is a malformed URL")))
    )


def with_origin(pages: DataFrame) -> DataFrame:
    """``scheme:host:port``; NULL for malformed URLs."""
    return pages.withColumn(
        "origin", F.when(u.is_valid(F.col("url")), u.origin(F.col("url")))
    )


def policy_urls(pages: DataFrame) -> DataFrame:
    """the two policy files on the page's origin."""
    site = u.site(F.col("url"))
    return pages.withColumns(
        {f"{kind}_url": F.concat(site, F.lit(p)) for kind, p in POLICY_PATHS.items()}
    )


def work_list(pages: DataFrame, fresh: DataFrame) -> DataFrame:
    """distinct origins without a fresh fetch, with their policy URLs."""
    origins = with_origin(validate(pages).where(F.col("error").isNull()))
    wanted = policy_urls(origins).groupBy("origin").agg(
        F.min("robots_url").alias("robots_url"), F.min("tdmrep_url").alias("tdmrep_url")
    )
    return wanted.join(fresh.select("origin").distinct(), "origin", "left_anti")


# --- F5 -----------------------------------------------------------------------


def cache_hits(
    requests: DataFrame,
    key: str = "origin",
    ts: str = "ts",
    row_id: str = "page_id",
    ttl_days: int = config.CACHE_TTL_DAYS,
) -> DataFrame:
    """adds ``cached`` under a write-based time to live; NULL without a key.

    A miss opens a span of ``ttl_days``; the next miss is the first request after it, found by
    :func:`spans.misses` in a fixed number of shuffles, whatever the time covered.  Of requests
    at the very same time the one of least ``row_id`` is the miss.  No task holds the requests of a key.
    """
    folder = f"{shared_dir(requests.sparkSession)}/spans-{uuid.uuid4().hex}"
    found = spans.misses(requests, key, ts, row_id, ttl_days, lambda paths: _written(paths, folder))
    flagged = requests.join(found.withColumn("cached", F.lit(False)), row_id, "left")
    return flagged.withColumn(
        "cached", F.when(F.col(key).isNotNull(), F.coalesce("cached", F.lit(True)))
    )


# --- F6, F7 -------------------------------------------------------------------


def policy_starts(origins: DataFrame) -> DataFrame:
    """``(origin, robots_url, tdmrep_url)`` to one row per origin and kind."""
    urls = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_url").alias("url")) for k in POLICY_PATHS]
    )
    return origins.select("origin", F.inline(urls))


def latest(fetches: DataFrame) -> DataFrame:
    """One row per kind and resource: the newest fetch, without content."""
    row = F.struct("status", "location", "error")
    return (
        fetches.withColumn("fetch_key", _log_key(F.col("url")))
        .groupBy("fetch_key")
        .agg(F.max_by(row, F.struct("ts", "url")).alias("_log"))
    )


def _log_key(address: Column) -> Column:
    return F.concat("kind", F.lit(" "), u.fetch_key(address))


def resolve_redirects(
    fetches: DataFrame, starts: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """follow at most five redirects inside the log, all origins at once.

    ``starts(origin, kind, url)`` are the policy URLs; the result has one row per
    start: ``(origin, kind, url, final_url, code, num_redirects, error)``.
    ``known(kind, origin, final_url, code, num_redirects, error)`` are results of an
    earlier run: a redirect to another origin's policy file takes that origin's result.

    Each hop writes its narrow outcome to a table in the shared folder.  That cuts
    the lineage, so a hop costs one join whatever its number; only the rows still
    redirected go on, and the loop ends as soon as none are left.  The log is shuffled
    once, when it is stored in buckets by key; see :func:`_looked_up`.
    """
    spark = fetches.sparkSession
    folder = f"{shared_dir(spark)}/redirects-{uuid.uuid4().hex}"
    name = f"redirects_{uuid.uuid4().hex}"
    log = _bucketed(latest(fetches), "fetch_key", f"{folder}/log", name)
    try:
        return _followed(log, starts, known, folder)
    finally:
        # Files stay in the folder; the name is not needed any more.
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _bucketed(df: DataFrame, key: str, folder: str, name: str) -> DataFrame:
    """The table, stored in as many buckets by ``key`` as a shuffle has partitions."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", folder)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _looked_up(open_rows: DataFrame, rows_open: int, log: DataFrame) -> DataFrame:
    """Left join of open rows with the bucketed log on ``fetch_key``; the log is never shuffled.

    Open rows are shuffled into the log's buckets (or the log is broadcast, where the optimizer
    sees that it is small).  Where they are many, those of the hottest keys stay where
    they are: their log rows, HOT_KEYS at most, go to them.
    """
    key = "fetch_key"
    hot = skew.hot_keys(open_rows, key) if rows_open > skew.PLAIN_ROWS else []
    if not hot:
        return open_rows.join(log, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = open_rows.where(is_hot).join(F.broadcast(log.where(F.col(key).isin(hot))), key, "left")
    return spread.unionByName(open_rows.where(~is_hot).join(log, key, "left"))


def _followed(
    log: DataFrame, starts: DataFrame, known: DataFrame | None, folder: str
) -> DataFrame:
    """The hops of :func:`resolve_redirects`."""
    counted = Observation()
    open_rows = _written(
        starts.select(
            "origin", "kind", "url", F.col("url").alias("at"), F.lit(0).alias("num_redirects")
        ),
        f"{folder}/starts",
        counted,
    )
    waiting = counted.get["n"]
    step = _hop(log, known)
    finished = []
    for hop in range(config.MAX_REDIRECTS + 1):
        counted = Observation()
        outcome = _written(
            step(open_rows, waiting, known is not None and hop > 0),
            f"{folder}/hop{hop}",
            counted,
            F.count_if(~F.col("done")),
        )
        finished.append(outcome.where("done").select(*_RESULT))
        waiting = counted.get["n"]
        if hop == config.MAX_REDIRECTS or not waiting:
            break
        open_rows = outcome.where("not done").select(
            "origin", "kind", "url", F.col("target").alias("at"),
            (F.col("num_redirects") + 1).alias("num_redirects"),
        )
    given_up = outcome.where("not done").select(
        "origin", "kind", "url",
        F.lit(None).cast("string").alias("final_url"),
        F.lit(None).cast("int").alias("code"),
        F.lit(None).cast("int").alias("num_redirects"),
        F.lit("Too many redirects").alias("error"),
    )
    return reduce(DataFrame.unionByName, [*finished, given_up])


_RESULT = ["origin", "kind", "url", "final_url", "code", "num_redirects", "error"]


def _written(
    df: DataFrame,
    folder: str,
    counted: Observation | None = None,
    count: Column | None = None,
) -> DataFrame:
    """Write a table to the shared folder, counting rows on the way, and go on from there."""
    if counted is not None:
        number = F.count(F.lit(1)) if count is None else count
        df.observe(counted, number.alias("n")).write.parquet(folder)
    else:
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _hop(log: DataFrame, known: DataFrame | None):
    """The step of one hop: look every row's URL up; arrived, failed or redirected.

    The expressions are the same for every hop, so they are built once.
    """
    none = F.lit(None).cast(_KNOWN_TYPE)
    shared = F.when(_is_policy_url(), F.concat("kind", F.lit(" "), u.origin(F.col("at"))))
    log_key = _log_key(F.col("at"))
    status, location = F.col("_log.status"), F.btrim("_log.location")
    blank = F.coalesce(location, F.lit("")) == ""
    first_state = (
        F.when(F.col("_known").isNotNull(), "known")
        .when(F.col("_log").isNull() | F.col("_log.error").isNotNull(), "failed")
        .when(~F.coalesce(status.isin(config.REDIRECT_CODES), F.lit(False)), "arrived")
        .when(blank, "lost")
        .otherwise("redirected")
    )
    now = F.col("state")
    reference = F.when(now == "redirected", location)
    add_target = u.resolver("at", "reference", "target")
    last = F.col("num_redirects") >= config.MAX_REDIRECTS
    refused = (now == "redirected") & ~F.coalesce(u.is_valid(F.col("target")), F.lit(False))
    state = (
        F.when(last & now.isin("redirected", "lost"), "redirected")
        .when(refused, "refused")
        .otherwise(now)
    )
    missing = F.concat(
        F.lit("Got redirect response "), status.cast("string"), F.lit(" for "),
        F.col("url"), F.lit(" without location"),
    )
    unknown = F.concat(F.lit("unknown protocol: "), F.regexp_extract("target", "^([^:]*)", 1))
    result = [
        F.when(now == "known", F.col("_known.final_url"))
        .when(now.isin("failed", "arrived"), F.col("at"))
        .alias("final_url"),
        F.when(now == "known", F.col("_known.code")).when(now == "arrived", status).alias("code"),
        F.when(now == "known", F.col("_known.num_redirects"))
        .when(now.isin("arrived", "redirected"), F.col("num_redirects"))
        .alias("num_redirects"),
        F.when(now == "known", F.col("_known.error"))
        .when(now == "failed", F.coalesce("_log.error", F.lit("not in the fetch log")))
        .when(now == "lost", missing)
        .when(now == "refused", unknown)
        .alias("error"),
        (now != "redirected").alias("done"),
    ]
    if known is not None:
        results = known.select(
            F.concat("kind", F.lit(" "), "origin").alias("known_key"),
            F.struct("final_url", "code", "num_redirects", "error").alias("_known"),
        )

    def step(open_rows: DataFrame, rows_open: int, with_known: bool) -> DataFrame:
        if with_known:
            keyed = open_rows.withColumn("known_key", shared)
            looked = skew.counted_join(keyed, rows_open, results, "known_key", ["origin"])
        else:
            looked = open_rows.withColumn("_known", none)
        joined = _looked_up(looked.withColumn("fetch_key", log_key), rows_open, log)
        staged = joined.withColumn("state", first_state).withColumn("reference", reference)
        settled = add_target(staged).withColumn("state", state)
        return settled.select("origin", "kind", "url", "target", *result)

    return step


_KNOWN_TYPE = "struct<final_url:string,code:int,num_redirects:int,error:string>"


def _is_policy_url() -> Column:
    path, kind = u.path(F.col("at")), F.col("kind")
    same = F.when(kind == "robots", path == "/robots.txt").otherwise(
        F.endswith(path, F.lit("/tdmrep.json"))
    )
    return same & ~F.contains(F.col("at"), F.lit("?"))


# --- F8 - F11 -----------------------------------------------------------------


def _newest_files(fetches: DataFrame, kind: str) -> DataFrame:
    """Content of the newest fetch of each resource of one kind."""
    keyed = (
        fetches.where((F.col("kind") == kind) & F.col("error").isNull())
        .withColumn("fetch_key", _log_key(F.col("url")))
    )
    row = F.struct("url", "content_type", "content")
    return (
        keyed.groupBy("fetch_key")
        .agg(F.max_by(row, F.struct("ts", "url")).alias("f"))
        .select("fetch_key", "f.url", "f.content_type", "f.content")
    )


def origin_policies(
    fetches: DataFrame,
    starts: DataFrame,
    agents: list[str] | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row per origin: rule sets and TDM columns, redirects followed.

    ``starts(origin, robots_url, tdmrep_url)``.  A failed fetch has no rule sets,
    which allows everything; the status is not consulted (F8).  ``known`` (see
    :func:`as_known`) also brings the rule sets and TDM files of an earlier run, which
    count where a short-cut leads to a file that this log does not hold.
    """
    resolved = resolve_redirects(fetches, policy_starts(starts), known).withColumn(
        "fetch_key", F.when(F.col("error").isNull(), _log_key(F.col("final_url")))
    )
    rules = robots.rule_sets(robots.parse(_newest_files(fetches, "robots")), agents).select(
        "fetch_key", "rule_sets"
    )
    robots_at = resolved.where(F.col("kind") == "robots")
    ruled = skew.lookup_join(robots_at, rules, "fetch_key", spread=["origin"])
    robots_side = _or_earlier(ruled, known, "robots", "rule_sets").select(
        "origin",
        F.struct("final_url", "code", "num_redirects", "error").alias("robots"),
        "rule_sets",
    )
    parsed = tdm.profile(_newest_files(fetches, "tdmrep")).select(
        "fetch_key",
        F.struct(
            "content_length", "content_type", "groups", "num_groups", "groups_text",
            F.col("error").alias("parse_error"),
        ).alias("file"),
    )
    tdm_at = resolved.where(F.col("kind") == "tdmrep")
    filed = skew.lookup_join(tdm_at, parsed, "fetch_key", spread=["origin"])
    tdm_side = _or_earlier(filed, known, "tdmrep", "file").select(
        "origin",
        F.struct("final_url", "code", "num_redirects", "error", "file").alias("tdmrep"),
    )
    return robots_side.join(tdm_side, "origin", "full")


def _or_earlier(found: DataFrame, known: DataFrame | None, kind: str, column: str) -> DataFrame:
    """where this run has no such file, what an earlier run made of it."""
    if known is None or column not in known.columns:
        return found
    usable = known.where((F.col("kind") == kind) & F.col("error").isNull() & F.col(column).isNotNull())
    # Origins that were sent to the same file have the same rules.
    earlier = usable.groupBy(_log_key(F.col("final_url")).alias("fetch_key")).agg(
        F.min_by(column, "origin").alias("_earlier")
    )
    both = skew.lookup_join(found, earlier, "fetch_key", spread=["origin"])
    return both.withColumn(column, F.coalesce(column, "_earlier")).drop("_earlier")


def as_known(policies: DataFrame) -> DataFrame:
    """results of :func:`origin_policies` as the ``known`` results of a later run."""
    file_type = policies.schema["tdmrep"].dataType["file"].dataType
    sets_type = policies.schema["rule_sets"].dataType

    def of(kind: str, sets: Column, file: Column) -> DataFrame:
        result = [F.col(f"{kind}.{c}").alias(c) for c in _RESULT[3:]]
        extra = [sets.cast(sets_type).alias("rule_sets"), file.cast(file_type).alias("file")]
        return policies.where(F.col(kind).isNotNull()).select(
            F.lit(kind).alias("kind"), "origin", *result, *extra
        )

    none = F.lit(None)
    return of("robots", F.col("rule_sets"), none).union(of("tdmrep", none, F.col("tdmrep.file")))


def page_policies(pages: DataFrame, policies: DataFrame) -> DataFrame:
    """adds ``denied`` (agents that may not fetch the page) and ``tdmrep``.

    One join on the origin, hot origins spread out.  The page brings its URL, never
    its HTML; the rules arrive as one row per origin and are walked inside it.
    """
    keyed = with_origin(pages)
    joined = skew.lookup_join(keyed, policies, "origin", spread=["url"])
    denied = robots.judge(u.path_query(F.col("url")), F.col("rule_sets"))
    return joined.withColumn("denied", denied).drop("rule_sets")


def denied_agents(judged: DataFrame, *carry: str) -> DataFrame:
    """F9, long form: one row per page and agent that may not fetch it."""
    return rows.exploded(judged, list(carry), "denied", "agent")


def denied_wide(judged: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """F9, wide form: a column per agent, false where denied and NULL otherwise."""
    names = [config.REFERENCE_AGENT, *config.agent_keys(agents)]
    return judged.withColumns(
        {
            f"agents.{a}": F.when(F.array_contains("denied", a), F.lit(False))
            for a in names
        }
    ).drop("denied")


def fetch_metadata(fetch_time: Column, cached: Column) -> Column:
    """everything the fetch adds to a page, under one prefix."""
    prefix = config.METADATA_PREFIX

    def one(name: str, value: Column) -> Column:
        return F.struct(
            F.lit(prefix + name).alias("key"),
            F.when(value.isNotNull(), F.array(value.cast("string"))).alias("value"),
        )

    t, r = F.col("tdmrep"), F.col("robots")
    fixed = F.array(
        one("fetchTime", F.unix_millis(fetch_time)),
        one("robots.url", r["final_url"]),
        one("robots.code", r["code"]),
        one("robots.num-redirects", r["num_redirects"]),
        one("robots.error", r["error"]),
        one("robots.cached", cached),
        one("tdmrep.url", t["final_url"]),
        one("tdmrep.code", t["code"]),
        one("tdmrep.num-redirects", t["num_redirects"]),
        one("tdmrep.error", F.coalesce(t["error"], t["file"]["parse_error"])),
        one("tdmrep.content-length", t["file"]["content_length"]),
        one("tdmrep.content-type", t["file"]["content_type"]),
        one("tdmrep.num-groups", t["file"]["num_groups"]),
        one("tdmrep.groups", t["file"]["groups_text"]),
    )
    agents = F.transform(
        "denied",
        lambda a: F.struct(
            F.concat(F.lit(f"{prefix}robots.agents."), a).alias("key"),
            F.array(F.lit("false")).alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(F.concat(fixed, agents), lambda e: e["value"].isNotNull()))
