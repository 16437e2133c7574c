"""URL frontier: robots rules, scope, de-duplication, ranking and caps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..settings import DEFAULTS, Settings
from ..storage import scratch_dir


def robots_rules(robots: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``robots`` (origin, status, body) to the rules that govern our agent: ``origin``,
    ``allow``, ``pattern`` (null for a host without rules), ``length``, ``delay``.

    Consecutive user-agent lines share the rules that follow.  Groups that name the
    agent, or all, come before ``*``; the rules of all governing groups are merged.  A
    missing file (404, 410) allows everything; another failure denies everything.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    lines = robots.where(F.col("status").between(200, 299)).select(
        "origin", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("pos", "raw")
    )
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select(
        "origin",
        "pos",
        F.lower(F.trim(F.regexp_extract(bare, "^([^:]*):", 1))).alias("name"),
        F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value"),
    ).where(F.col("name").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("origin").orderBy("pos")
    agent = F.col("name") == "user-agent"
    opens = agent & ~F.coalesce(F.lag("name").over(w) == "user-agent", F.lit(False))
    lines = lines.withColumn("grp", F.sum(opens.cast("int")).over(w))
    named = F.contains(F.lower("value"), F.lit(settings.robots_agent.lower())) | (F.lower("value") == "all")
    groups = (
        lines.where(agent)
        .groupBy("origin", "grp")
        .agg(F.max(F.when(named, 2).when(F.col("value") == "*", 1).otherwise(0)).alias("rank"))
        .where("rank > 0")
    )
    best = Window.partitionBy("origin")
    groups = groups.withColumn("best", F.max("rank").over(best)).where("rank = best").select("origin", "grp")
    governing = lines.where(~agent).join(groups.hint("merge"), ["origin", "grp"])
    slash = F.when(
        F.startswith("value", F.lit("/")) | F.col("value").isin("*", "$"), F.col("value")
    ).otherwise(F.concat(F.lit("/"), F.col("value")))
    rule = F.when(F.col("value") != "", slash)
    rules = governing.where(F.col("name") != "crawl-delay").select(
        "origin", (F.col("name") == "allow").alias("allow"), rule.alias("rule"), F.lit(None).cast("double").alias("delay")
    )
    delays = governing.where("name = 'crawl-delay'").select(
        "origin", F.lit(True).alias("allow"), F.lit(None).cast("string").alias("rule"), F.expr("try_cast(value AS double)").alias("delay")
    )
    known = robots.select(
        "origin",
        (F.col("status").between(200, 299) | F.col("status").isin(404, 410)).alias("allow"),
        F.when(F.col("status").between(200, 299) | F.col("status").isin(404, 410), F.lit(None)).otherwise("/").alias("rule"),
        F.lit(None).cast("double").alias("delay"),
    )
    anchored = F.endswith("rule", F.lit("$"))
    literal = F.regexp_replace("rule", r"\$$", "")
    escaped = F.regexp_replace(literal, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))
    length = F.length(F.regexp_replace(F.replace(F.col("rule"), F.lit("*"), F.lit("")), r"\$+$", ""))
    return rules.unionByName(delays).unionByName(known).select(
        "origin", "allow", F.when(F.col("rule").isNotNull(), pattern).alias("pattern"), length.alias("length"), "delay"
    )


def robots_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (origin, path, and others) with ``robots_allowed``: the longest matching rule
    wins, allow wins ties, no match allows; an origin without any row is denied.

    All sides may grow with the crawl, and their sizes are guessed too small by what they are exploded from,
    so they are joined by sorted shuffles."""
    asked = urls.select("origin", "path").distinct()
    path = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit("/"), F.col("path")))
    matched = (
        asked.join(rules.where("pattern IS NOT NULL").hint("merge"), "origin")
        .where(F.expr("CASE WHEN startswith(path, '/') THEN path ELSE concat('/', path) END RLIKE pattern"))
        .groupBy("origin", "path")
        .agg(F.max_by("allow", F.struct("length", "allow")).alias("matched"))
    )
    known = rules.select("origin").distinct().withColumn("known", F.lit(True))
    allowed = F.when(F.col("known").isNull(), False).otherwise(F.coalesce("matched", F.lit(True)))
    return (
        urls.join(known.hint("merge"), "origin", "left")
        .join(matched.hint("merge"), ["origin", "path"], "left")
        .withColumn("robots_allowed", allowed)
        .drop("known", "matched")
    )


def crawl_delays(rules: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The larger of the configured delay and any governing group's, per origin."""
    return rules.groupBy("origin").agg(
        F.greatest(F.lit(settings.crawl_delay_seconds), F.coalesce(F.max("delay"), F.lit(0.0))).alias("delay")
    )


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``sitemaps`` (start_url, xml) to ``start_url``, ``href``, ``is_sitemap``: entries that
    end in .xml are further sitemaps, the others pages."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)
    href = F.col("loc")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        href = F.replace(href, F.lit(name), F.lit(char))
    return sitemaps.select("start_url", F.explode(locs).alias("loc")).select(
        "start_url", href.alias("href"), F.endswith(href, F.lit(".xml")).alias("is_sitemap")
    )


def candidates(starts: DataFrame, page_links: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Start pages, sitemap pages and links as one table: ``start_url``, ``href``, ``depth``,
    ``via`` and ``seq``, the order in which a source's URLs are first seen."""
    start = starts.select("start_url", F.col("start_url").alias("href"), F.lit(0).alias("depth"), F.lit("start").alias("via"), F.lit(0).cast("long").alias("seq"))
    smap = sitemap.where("NOT is_sitemap").select("start_url", "href", F.lit(1).alias("depth"), F.lit("sitemap").alias("via"), F.lit(1).cast("long").alias("seq"))
    found = page_links.select("start_url", "href", F.lit(1).alias("depth"), F.lit("link").alias("via"), (F.col("pos") + 2).cast("long").alias("seq"))
    return start.unionByName(smap).unionByName(found)


def verdicts(
    found: DataFrame, rules: DataFrame | None = None, base: str = "start_url", seen_by: tuple[str, ...] = ("depth", "seq", "via")
) -> DataFrame:
    """Candidates with ``url``, resolved against the column ``base``, and ``verdict``: malformed,
    out_of_scope, disallowed, duplicate or admitted, tested in this order; the first seen of
    equal URLs, by the columns ``seen_by``, is no duplicate."""
    rows = found.withColumn("url", U.resolved("href", base))
    rows = rows.withColumn("origin", F.concat(U.scheme("url"), F.lit("://"), U.authority("url")))
    rows = rows.withColumn("path", U.path("url"))
    rows = robots_verdicts(rows, rules) if rules is not None else rows.withColumn("robots_allowed", F.lit(True))
    first = F.when(F.col("url").isNull(), "malformed").when(~U.in_scope("url", "start_url"), "out_of_scope").when(
        ~F.col("robots_allowed"), "disallowed"
    )
    rows = rows.withColumn("verdict", first)
    w = Window.partitionBy("start_url", "url", F.col("verdict").isNull()).orderBy(*seen_by)
    again = F.when(F.row_number().over(w) > 1, "duplicate").otherwise("admitted")
    return rows.withColumn("verdict", F.coalesce("verdict", again)).drop("origin", "path", "robots_allowed")


def frontier(judged: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Admitted URLs ranked by depth and then URL, at most the page cap per source."""
    w = Window.partitionBy("start_url").orderBy("depth", "url")
    return (
        judged.where((F.col("verdict") == "admitted") & (F.col("depth") <= settings.crawl_max_depth))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= settings.crawl_max_pages)
        .select("start_url", "url", "depth", "via", "rank")
    )


def refusals(judged: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Counts of every verdict, and of what the cap cut, per source."""
    counts = judged.where("verdict != 'admitted'").groupBy("start_url", "verdict").count()
    admitted = judged.where((F.col("verdict") == "admitted") & (F.col("depth") <= settings.crawl_max_depth))
    capped = (
        admitted.groupBy("start_url")
        .agg(F.greatest(F.count("*") - settings.crawl_max_pages, F.lit(0)).alias("count"))
        .where("count > 0")
        .select("start_url", F.lit("capped").alias("verdict"), "count")
    )
    return counts.unionByName(capped)


def is_admissible(urls: DataFrame, allowed: list[str] | Column) -> DataFrame:
    allowed = F.array(*[F.lit(d) for d in allowed]) if isinstance(allowed, list) else allowed
    return urls.withColumn("refusal", U.admissibility("url", allowed))


def crawl_candidates(pages: DataFrame, tombstones: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Frontier rows (source_id, url, depth) within the depth, ranked and capped, with
    ``skip`` set on those that a tombstone names; skipped rows count against the cap."""
    w = Window.partitionBy("source_id").orderBy("depth", "url")
    dead = tombstones.select("source_id", "url", F.lit("tombstoned").alias("skip")).distinct()
    return (
        pages.where(F.col("depth") <= settings.crawl_max_depth)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= settings.crawl_max_pages)
        .join(dead, ["source_id", "url"], "left")
    )


def crawl(
    starts: DataFrame, links: DataFrame, rules: DataFrame | None = None, depth: int | None = None, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Follow links from the start pages, over as many hops as ``depth`` (else the setting) allows.

    ``starts`` has start_url, ``links`` has url, href and pos: what each known page links to.  A
    round joins the pages found last with their links, judges each target as ``verdicts``
    does, and keeps those of a source that it has not visited; each round's pages
    are written, and the visited set is the table of all rounds.  It ends when nothing new
    comes.  Of the links that reach a page first, the one with the least parent and place counts.

    Returns the visited pages, ``start_url``, ``url``, ``depth`` and ``parent``, and the refused links
    of every round, ``start_url``, ``url``, ``depth`` and ``verdict`` (malformed, out_of_scope, disallowed
    or duplicate), one row per link.
    """
    spark = starts.sparkSession
    top = f"{scratch_dir(spark)}/crawl-{uuid.uuid4().hex}"
    most = settings.crawl_max_depth if depth is None else depth
    pages = "start_url string, url string, parent string, depth int"
    refused = "start_url string, url string, verdict string, depth int"
    first = candidates(starts, links.limit(0).select(F.col("url").alias("start_url"), "href", "pos"), sitemap_urls(starts.select("start_url", F.lit("").alias("xml"))))
    judged = verdicts(first.dropDuplicates(["start_url"]), rules).withColumn("parent", F.lit(None).cast("string"))
    for hop in range(most + 1):
        judged = judged.withColumn("depth", F.lit(hop))
        judged.write.parquet(f"{top}/judged/hop={hop}")
        judged = spark.read.parquet(f"{top}/judged/hop={hop}")
        judged.where("verdict = 'admitted'").select("start_url", "url", "parent", "depth").write.mode("append").parquet(f"{top}/visited")
        judged.where("verdict != 'admitted'").select("start_url", "url", "verdict", "depth").write.mode("append").parquet(f"{top}/refused")
        visited = spark.read.schema(pages).parquet(f"{top}/visited")
        last = visited.where(F.col("depth") == hop)
        if hop == most or last.isEmpty():
            break
        found = last.select("start_url", F.col("url").alias("parent")).join(links.select(F.col("url").alias("parent"), "href", "pos"), "parent")
        found = found.withColumn("via", F.lit("link")).withColumn("seq", F.col("pos").cast("long")).withColumn("depth", F.lit(hop + 1))
        judged = _beyond(verdicts(found, rules, base="parent", seen_by=("parent", "seq")), visited)
    return visited, spark.read.schema(refused).parquet(f"{top}/refused")


def _beyond(judged: DataFrame, visited: DataFrame) -> DataFrame:
    """Admitted links to pages that were visited in an earlier round are duplicates."""
    before = visited.select("start_url", "url", F.lit(True).alias("_seen"))
    rows = judged.join(before, ["start_url", "url"], "left")
    seen = (F.col("verdict") == "admitted") & F.col("_seen").isNotNull()
    return rows.withColumn("verdict", F.when(seen, "duplicate").otherwise(F.col("verdict"))).drop("_seen")
