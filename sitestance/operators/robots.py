"""robots.txt corpus analytics: document -> lines -> groups -> rules -> statistics.

One row is one document from scan to statistics.  A document is bounded by the
content limit of the scan, so its lines live in an array column and every step is
a projection: the whole profile runs without a single exchange, whatever the
number of lines.  The long tables (:func:`lines`, :func:`agent_groups`,
:func:`agent_rows`) are plain ``explode``s of those arrays, so the shuffles of a
study query start from pre-reduced rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions import match, rows, text

ASTERISK = "*"


# --- R1, R2: early outs and decoding -----------------------------------------


def admit(docs: DataFrame) -> DataFrame:
    """Adds ``content_length``, the kept ``content_type`` and ``is_parsed``.

    Null content gives nothing; zero bytes give a length only; an HTML content
    type is noted, but such a document is not parsed.
    """
    length = F.octet_length("content")
    kind = F.when(length > 0, F.col("content_type"))
    html = F.coalesce(F.startswith(F.lower("content_type"), F.lit("text/html")), F.lit(False))
    return docs.withColumns(
        {
            "content_length": length,
            "content_type": kind,
            "is_parsed": F.coalesce((length > 0) & ~html, F.lit(False)),
        }
    )


# --- R3 - R6: lines and directives -------------------------------------------


_SPELLINGS = "|".join(s for forms in config.DIRECTIVES.values() for s in forms)
_DELIMITED = r"(?:[ \t]*:[ \t]*|[ \t]+)(.*)$"
_RECOGNISE = rf"(?i)^({_SPELLINGS}){_DELIMITED}"
_RECOGNISE_PREFIXED = rf"(?i)^({config.PREFIX_DIRECTIVE})[^: \t]+{_DELIMITED}"


def raw_lines(decoded: Column) -> Column:
    """Non-empty pieces between line ends; comments and blanks still count."""
    return F.filter(F.split(decoded, text.LINE_BREAKS, -1), lambda x: x != "")


def _directive_names() -> Column:
    names = {form: name for name, forms in config.DIRECTIVES.items() for form in forms}
    return text.constant(names, "map<string,string>")


def directive_of(line: Column) -> Column:
    """A comment-free, trimmed line to ``struct<directive, value>``."""
    known = F.try_element_at(_directive_names(), F.lower(F.regexp_extract(line, _RECOGNISE, 1)))
    prefixed = F.regexp_extract(line, _RECOGNISE_PREFIXED, 1) != ""
    special = F.when(F.startswith(line, F.lit(":")), F.lit("unknown")).otherwise(F.lit("missing"))
    value = text.control_trim(
        F.when(known.isNotNull(), F.regexp_extract(line, _RECOGNISE, 2))
        .when(prefixed, F.regexp_extract(line, _RECOGNISE_PREFIXED, 2))
        .otherwise(line)
    )
    return F.struct(
        F.coalesce(known, F.when(prefixed, F.lit(config.PREFIX_DIRECTIVE)), special).alias(
            "directive"
        ),
        value.alias("value"),
    )


def tokenise(raw: Column) -> Column:
    """Raw lines to ``array<struct<n, directive, value>>``; comments and blanks dropped."""
    stripped = F.transform(
        raw,
        lambda x, i: F.struct(
            (i + 1).alias("n"), text.control_trim(F.regexp_replace(x, "#.*", "")).alias("text")
        ),
    )
    kept = F.filter(stripped, lambda x: x["text"] != "")
    return F.transform(
        F.transform(kept, lambda x: F.struct(x["n"].alias("n"), directive_of(x["text"]).alias("d"))),
        lambda x: F.struct(
            x["n"].alias("n"),
            x["d"]["directive"].alias("directive"),
            x["d"]["value"].alias("value"),
        ),
    )


# --- R7: agent groups ---------------------------------------------------------


def groups_of(tokens: Column) -> Column:
    """Tokens to ``array<struct<agents array<string>, rules array<struct<allow, pattern>>>>``.

    Only allow and disallow lines end a run of agents.  Each of the three kinds of
    line is written with its letter at both ends; a group then starts exactly where
    an agent line follows a rule line, which one ``split`` finds in linear time.
    """
    letter = {"user-agent": "U", "allow": "A", "disallow": "D"}
    marks = F.create_map(*[F.lit(x) for pair in letter.items() for x in pair])
    marked = F.transform(
        F.filter(tokens, lambda t: t["directive"].isin(*letter)),
        lambda t: F.concat(marks[t["directive"]], t["value"], marks[t["directive"]]),
    )
    chunks = F.filter(
        F.split(F.array_join(marked, "\n"), r"(?<=[AD])\n(?=U)", -1), lambda c: c != ""
    )

    def inner(entry: Column) -> Column:
        return entry.substr(F.lit(2), F.length(entry) - 2)

    def group(entries: Column) -> Column:
        agents = F.transform(
            F.filter(entries, lambda e: F.startswith(e, F.lit("U"))), lambda e: F.lower(inner(e))
        )
        rules = F.transform(
            F.filter(entries, lambda e: ~F.startswith(e, F.lit("U"))),
            lambda e: F.struct(
                F.startswith(e, F.lit("A")).alias("allow"), inner(e).alias("pattern")
            ),
        )
        return F.struct(agents.alias("agents"), rules.alias("rules"))

    return F.transform(F.transform(chunks, lambda c: F.split(c, "\n", -1)), group)


# --- R8 - R13: statistics of one document -------------------------------------


def _count(tokens: Column, directive: str, empty: bool | None = None) -> Column:
    def wanted(t: Column) -> Column:
        hit = t["directive"] == directive
        if empty is None:
            return hit
        return hit & ((t["value"] == "") if empty else (t["value"] != ""))

    return F.when(tokens.isNotNull(), F.size(F.filter(tokens, wanted)))


def _values(tokens: Column, directive: str) -> Column:
    return F.transform(
        F.filter(tokens, lambda t: t["directive"] == directive), lambda t: t["value"]
    )


def crawl_delay_of(tokens: Column) -> Column:
    """Largest whole-number delay of any agent; NULL when none is above -1."""
    numbers = F.transform(
        F.filter(_values(tokens, "crawl-delay"), lambda v: v.rlike("^[+-]?[0-9]+$")),
        lambda v: v.try_cast("int"),
    )
    largest = F.array_max(numbers)
    return F.when(largest > -1, largest)


def directories_of(tokens: Column) -> Column:
    """Distinct lower-cased folders in the rules of all agents."""
    paths = F.transform(
        F.filter(tokens, lambda t: t["directive"].isin("allow", "disallow")),
        lambda t: F.regexp_replace(F.lower(t["value"]), r"/\*$", "/"),
    )
    return F.array_distinct(
        F.filter(paths, lambda p: F.startswith(p, F.lit("/")) & F.endswith(p, F.lit("/")))
    )


def _sorted_set(values: Column) -> Column:
    distinct = F.array_sort(F.array_distinct(F.transform(values, F.lower)))
    return F.when(F.size(distinct) > 0, distinct)


def rules_for(groups: Column, agent: Column) -> Column:
    """All rules of the groups naming ``agent``, merged, compiled, in priority order."""
    own = F.filter(groups, lambda g: F.array_contains(g["agents"], agent))
    plain = F.filter(
        F.flatten(F.transform(own, lambda g: g["rules"])), lambda r: r["pattern"] != ""
    )
    return match.in_priority_order(
        F.transform(plain, lambda r: match.compile_rule(r["pattern"], r["allow"]))
    )


def probe_base(url: Column) -> Column:
    """What comes between the authority and a probed path: usually nothing."""
    base = F.regexp_replace(url, r"/robots\.txt$", "")
    return F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")


def parse(docs: DataFrame) -> DataFrame:
    """Adds ``num_lines``, ``tokens`` and ``groups`` to admitted documents."""
    raw = F.when(F.col("is_parsed"), raw_lines(text.decode_text(F.col("content"))))
    return (
        admit(docs)
        .withColumn("raw", raw)
        .withColumns({"num_lines": _size_or_null("raw"), "tokens": tokenise(F.col("raw"))})
        .withColumn("groups", groups_of(F.col("tokens")))
        .drop("raw", "content")
    )


def _size_or_null(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.size(name))


def _agent_counts(groups: Column, agent: Column) -> Column:
    """Counts over the groups of one agent; an agent repeated in a group counts again."""

    def per_group(g: Column) -> Column:
        times = F.size(F.filter(g["agents"], lambda a: a == agent))

        def n(cond) -> Column:
            return times * F.size(F.filter(g["rules"], cond))

        return F.struct(
            n(lambda r: r["allow"] & (r["pattern"] != "")).alias("allow"),
            n(lambda r: ~r["allow"] & (r["pattern"] != "")).alias("disallow"),
            n(lambda r: ~r["allow"] & (r["pattern"] == "")).alias("empty"),
        )

    return F.transform(F.filter(groups, lambda g: F.array_contains(g["agents"], agent)), per_group)


def _sum(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0), lambda acc, r: acc + r[field])


def profile(docs: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """The full statistics of every document (R1 - R19), one row in, one row out.

    ``agents`` holds one entry per tracked agent named in the file, plus ``*``:
    counts (R12), blanket ban (R15) and, for tracked agents, bias (R16).
    """
    tracked = config.agent_keys(agents)
    parsed = parse(docs) if "tokens" not in docs.columns else docs
    tokens, groups = F.col("tokens"), F.col("groups")
    named = F.array_distinct(F.transform(_values(tokens, "user-agent"), F.lower))
    listed = text.constant(tracked, "array<string>")

    staged = parsed.withColumns(
        {
            "num_disallow": _count(tokens, "disallow", empty=False),
            "num_disallow_empty": _count(tokens, "disallow", empty=True),
            "num_allow": _count(tokens, "allow", empty=False),
            "num_sitemaps": _count(tokens, "sitemap"),
            "sitemaps": _sorted_set(_values(tokens, "sitemap")),
            "useragents": F.array_sort(named),
            "crawldelay": crawl_delay_of(tokens),
            "directories": directories_of(tokens),
            "base": probe_base(F.col("url")),
        }
    ).withColumns(
        {
            "num_useragents": _size_or_null("useragents"),
            "useragents": F.when(F.size("useragents") > 0, F.col("useragents")),
            # The asterisk is always tested, tracked agents only where named.
            "subjects": F.when(
                tokens.isNotNull(),
                F.concat(
                    F.array(F.lit(ASTERISK)), F.array_intersect(listed, F.col("useragents"))
                ),
            ),
            "probes": F.transform("directories", lambda d: _probe(F.col("base"), d)),
        }
    )
    # An arbitrary bot follows the asterisk groups; a named agent its own.
    ruled = staged.withColumn(
        "ruled",
        F.transform(
            "subjects",
            lambda a: F.struct(
                a.alias("agent"),
                match.program(rules_for(groups, a)).alias("program"),
                _agent_counts(groups, a).alias("counts"),
            ),
        ),
    )
    probes, root = F.col("probes"), _probe(F.col("base"), F.lit("/"))
    judged = ruled.withColumn(
        "judged",
        F.transform(
            "ruled",
            lambda r: F.struct(
                r["agent"].alias("agent"),
                _sum(r["counts"], "allow").alias("num_allow"),
                _sum(r["counts"], "disallow").alias("num_disallow"),
                _sum(r["counts"], "empty").alias("num_disallow_empty"),
                match.passes(root, r["program"]).alias("may_read_root"),
                F.size(F.filter(probes, lambda p: match.passes(p, r["program"]))).alias("readable"),
            ),
        ),
    )
    arbitrary = F.col("judged")[0]["readable"]
    summary = F.transform(
        "judged",
        lambda j: F.struct(
            j["agent"].alias("agent"),
            j["num_allow"].alias("num_allow"),
            j["num_disallow"].alias("num_disallow"),
            j["num_disallow_empty"].alias("num_disallow_empty"),
            (
                ~j["may_read_root"]
                & (j["num_disallow"] == 1)
                & (j["num_disallow_empty"] == 0)
                & (j["num_allow"] == 0)
            ).alias("disallow_all"),
            F.when(j["agent"] != ASTERISK, j["readable"] - arbitrary).alias("bias"),
        ),
    )
    return judged.withColumn("agents", summary).drop("subjects", "ruled", "judged", "base", "probes")


def _probe(base: Column, folder: Column) -> Column:
    """The probed path in one spelling; a fragment in the base URL hides what follows it."""
    whole = F.concat(base, folder, F.lit("42"))
    seen = F.when(F.contains(whole, F.lit("#")), F.substring_index(whole, "#", 1)).otherwise(whole)
    return match.normalised(seen)


# --- long tables ---------------------------------------------------------------


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "crawl", "url") if c in df.columns]


def lines(parsed: DataFrame) -> DataFrame:
    """``robots_lines(doc_id, n, directive, value)``: one row per directive line."""
    return rows.inlined(parsed, _carried(parsed), "tokens", "n")


def agent_groups(parsed: DataFrame) -> DataFrame:
    """``robots_groups(doc_id, grp, agents, rules)``: one row per group, from 1."""
    return rows.numbered(parsed, _carried(parsed), "groups", "grp", "g").select(
        *_carried(parsed), (F.col("grp") + 1).alias("grp"), "g.agents", "g.rules"
    )


def rules(parsed: DataFrame) -> DataFrame:
    """``robots_rules(doc_id, grp, pos, allow, pattern)``: one row per rule line."""
    grouped = agent_groups(parsed)
    keep = [c for c in grouped.columns if c not in ("agents", "rules")]
    return rows.numbered(grouped, keep, "rules", "pos", "rule").select(
        *keep, "pos", "rule.allow", "rule.pattern"
    )


def agent_rows(profiles: DataFrame) -> DataFrame:
    """One row per document and agent."""
    return rows.inlined(profiles, _carried(profiles), "agents", "agent")


def agent_counts(profiles: DataFrame) -> DataFrame:
    """Agents with at least one rule; the asterisk is named ``asterisk``."""
    total = F.col("num_allow") + F.col("num_disallow") + F.col("num_disallow_empty")
    return (
        agent_rows(profiles)
        .where(total > 0)
        .withColumn("agent", agent_label(F.col("agent")))
        .drop("disallow_all", "bias")
    )


def agent_label(agent: Column) -> Column:
    return F.when(agent == ASTERISK, F.lit("asterisk")).otherwise(agent)


# --- rule sets for page verdicts (R14 as used by F9) ----------------------------


def rule_sets(parsed: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """Adds ``rule_sets``: ``array<struct<agents, rules>>`` covering every tracked agent.

    Agents without a group of their own share the asterisk's rules with the
    reference agent, so a page is judged once per distinct rule set.
    """
    tracked = config.agent_keys(agents)
    listed = text.constant(tracked, "array<string>")
    reference = config.REFERENCE_AGENT
    groups = F.coalesce(F.col("groups"), F.array().cast(GROUPS_TYPE))
    named = F.array_distinct(F.flatten(F.transform(groups, lambda g: g["agents"])))
    own = F.array_intersect(listed, named)
    # The reference agent follows a group with its own name, should one exist.
    ref_key = F.lit(reference.lower())
    ref_named = F.array_contains(named, ref_key)
    others = F.array_except(listed, named)

    def one(names: Column, key: Column) -> Column:
        return F.struct(names.alias("agents"), match.index(rules_for(groups, key)).alias("rules"))

    shared_names = F.when(ref_named, others).otherwise(F.concat(F.array(F.lit(reference)), others))
    shared = one(shared_names, F.lit(ASTERISK))
    def binding(s: Column) -> Column:
        return F.size(s["rules"]["literal"]) + F.size(s["rules"]["wild"]) > 0

    sets = F.concat(
        F.array(shared),
        F.transform(own, lambda a: one(F.array(a), a)),
        F.when(ref_named, F.array(one(F.array(F.lit(reference)), ref_key))).otherwise(
            F.array().cast(SETS_TYPE)
        ),
    )
    return parsed.withColumn("rule_sets", F.filter(sets, binding))


GROUPS_TYPE = "array<struct<agents:array<string>,rules:array<struct<allow:boolean,pattern:string>>>>"
SETS_TYPE = f"array<struct<agents:array<string>,rules:{match.INDEX_TYPE}>>"


def judge(path: Column, sets: Column) -> Column:
    """Agents that may *not* read ``path``; an absent rule set denies nothing."""

    def denied(known: Column) -> Column:
        denying = F.filter(sets, lambda s: ~match.verdict(known, s["rules"]))
        return F.array_sort(F.flatten(F.transform(denying, lambda s: s["agents"])))

    # The path is brought into one spelling once, not once for each rule set.
    names = F.element_at(F.transform(F.array(match.normalised(path)), denied), 1)
    return F.coalesce(names, F.array().cast("array<string>"))


def verdicts(probes: DataFrame, documents: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """R14 for ``probes(doc_id, path)``: one row per probe and denied agent.

    ``documents`` has one row per ``doc_id``, so the join multiplies nothing; the
    comparison with the rules happens inside the joined row.
    """
    from sitestance.operators.skew import lookup_join

    sets = rule_sets(documents, agents).select("doc_id", "rule_sets")
    joined = lookup_join(probes, sets, "doc_id")
    denied = judge(F.col("path"), F.col("rule_sets"))
    return rows.exploded(joined, ["doc_id", "path"], denied, "agent")


# --- E6 helper: the dotted names of the index document --------------------------


def as_metadata(profiles: DataFrame, prefix: str = "robots.") -> Column:
    """The statistics as a dotted ``map<string, array<string>>``."""

    def one(name: str, value: Column) -> Column:
        return F.struct(
            F.lit(prefix + name).alias("key"),
            F.when(value.isNotNull(), F.array(value.cast("string"))).alias("value"),
        )

    def many(name: str, value: Column) -> Column:
        return F.struct(F.lit(prefix + name).alias("key"), value.alias("value"))

    scalars = [
        one("content-length", F.col("content_length")),
        one("content-type", F.col("content_type")),
        one("num-lines", F.col("num_lines")),
        one("num-disallow", F.col("num_disallow")),
        one("num-disallow-empty", F.col("num_disallow_empty")),
        one("num-allow", F.col("num_allow")),
        one("num-sitemaps", F.col("num_sitemaps")),
        many("sitemaps", F.col("sitemaps")),
        one("num-useragents", F.col("num_useragents")),
        many("useragents", F.col("useragents")),
        one("crawldelay", F.col("crawldelay")),
    ]
    if "status" in profiles.columns:
        scalars.append(one("code", F.col("status")))

    def dotted(name: str, row: Column, value: Column) -> Column:
        return F.struct(
            F.concat(F.lit(prefix + name + "."), agent_label(row["agent"])).alias("key"),
            F.when(value.isNotNull(), F.array(value.cast("string"))).alias("value"),
        )

    def per_agent(row: Column) -> Column:
        total = row["num_allow"] + row["num_disallow"] + row["num_disallow_empty"]
        ruled = total > 0
        return F.array(
            dotted("num-allow-per-agent", row, F.when(ruled, row["num_allow"])),
            dotted("num-disallow-per-agent", row, F.when(ruled, row["num_disallow"])),
            dotted(
                "num-disallow-empty-per-agent",
                row,
                F.when(row["num_disallow_empty"] > 0, row["num_disallow_empty"]),
            ),
            dotted("disallow-all", row, F.when(row["disallow_all"], row["disallow_all"])),
            dotted("bias", row, row["bias"]),
        )

    agents = F.flatten(F.transform("agents", per_agent))
    empty = F.array().cast("array<struct<key:string,value:array<string>>>")
    entries = F.concat(F.array(*scalars), F.coalesce(agents, empty))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))



def raw_line_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, raw)``, comments and blanks included."""
    parsed = admit(docs).where(F.col("is_parsed"))
    pieces = raw_lines(text.decode_text(F.col("content")))
    return rows.numbered(parsed, _carried(parsed), pieces, "n", "raw").withColumn(
        "n", F.col("n") + 1
    )
