"""URL lists in time.

Lists change: an entry is added, removed, added again. Its dated changes become validity
intervals, which do not overlap. A capture is looked up under its page, its host and every
parent domain, as of the time it was fetched: the interval that began last must not have
ended by then. Intervals are cut at period borders, so that key and period make an
equality join, and at most the changes within one period are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.common import BROADCAST_ROWS, SALTS
from breezeway.session import materialise

PERIOD_SECONDS = 30 * 86400
#: A list is broadcast up to so many bytes of patterns, and BROADCAST_ROWS.
BROADCAST_BYTES = 16 << 20
#: In a longer list, entries that are asked for more often than this in a period are joined apart.
HOT_ROWS = 10_000


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null if there is none.

    An IPv6 address keeps its brackets.
    """
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def page(url: Column) -> Column:
    """Host and path of a URL, without a final slash; null if it has no host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path, "/+$", ""))


def is_address(name: Column) -> Column:
    """Whether a host is an IPv4 or IPv6 address, which has no parent domains."""
    return name.rlike(r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$")


def lookup_keys(url: Column) -> Column:
    """Patterns that a list may have for a URL, the most specific first: page, host, parent domains of two labels or more.

    An address has no parents.
    """
    labels = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(F.array(page(url)), F.when(is_address(host(url)), F.array(host(url))).otherwise(parents)))


def intervals(changes: DataFrame) -> DataFrame:
    """Validity intervals pattern, since, until of dated ``changes`` (pattern, at, added).

    An entry is active from an add up to the next remove; adds in between change nothing.
    Of changes at one time the add counts last. ``until`` is null while it is active.
    Changes without pattern, time or kind are ignored.
    """
    known = changes.where("pattern IS NOT NULL AND at IS NOT NULL AND added IS NOT NULL").groupBy("pattern", "at").agg(
        F.max("added").alias("added"))
    w = Window.partitionBy("pattern").orderBy("at")
    turns = known.withColumn("_was", F.lag("added").over(w)).where(
        F.col("added") != F.coalesce("_was", F.lit(False)))
    return turns.withColumn("until", F.lead("at").over(w)).where("added").select(
        "pattern", F.col("at").alias("since"), "until")


def active_entries(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per capture of ``captures`` (key, url, at): key, host, at, blocked, n_entries, entry, since.

    ``n_entries`` counts the list entries active at the time of the fetch, ``entry`` is the
    most specific, ``since`` the start of its validity. A URL without host, a null URL and
    a null time match nothing. Repeated captures are answered each; an empty list blocks
    nothing. The list is broadcast while it is short. Of a longer one only the entries of hot
    hosts are, so that their captures stay where they are; should those be many, they are
    repeated over SALTS values. The rest is shuffled once and never broadcast, whatever size
    Spark takes it for: its files are far smaller than its rows.
    """
    spans = materialise(intervals(changes), "intervals")
    period = lambda at: F.floor(F.unix_timestamp(at) / PERIOD_SECONDS)
    rows = materialise(captures.select(
        F.monotonically_increasing_id().alias("row"), "key", F.col("at"), host(F.col("url")).alias("host"),
        F.coalesce(lookup_keys(F.col("url")), F.array().cast("array<string>")).alias("patterns")), "captures")
    # the newest fetch bounds how far an open interval is cut
    newest = rows.agg(F.max("at").alias("_newest")).scalar()
    cut = spans.withColumn("_newest", newest).where(F.col("since") <= F.col("_newest")).select(
        "pattern", "since", "until",
        F.explode(F.sequence(period(F.col("since")), period(F.least(F.coalesce("until", "_newest"), F.col("_newest")))))
        .alias("period"))
    cut = materialise(cut, "periods")
    asked = rows.select("row", "at", period(F.col("at")).alias("_period"), F.posexplode("patterns").alias("_nth", "_pattern"))
    same = (F.col("_pattern") == F.col("pattern")) & (F.col("_period") == F.col("period"))
    within = (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    n, n_bytes = cut.agg(F.count(F.lit(1)), F.sum(F.octet_length("pattern"))).first()
    if n <= BROADCAST_ROWS and (n_bytes or 0) <= BROADCAST_BYTES:
        hits = asked.join(F.broadcast(cut), same & within)
    else:
        times = asked.groupBy("_pattern", "_period").agg(F.count(F.lit(1)).alias("_times"))
        often = max(HOT_ROWS, rows.count() // max(BROADCAST_ROWS, 1))
        listed = times.where(F.col("_times") > often).join(cut.hint("merge"), same, "left_semi")
        hot = materialise(listed.select("_pattern", "_period"), "hot")
        hot_cut = materialise(cut.join(F.broadcast(hot), same, "left_semi"), "hot-periods")
        hits = asked.join(F.broadcast(hot), ["_pattern", "_period"], "left_anti").join(cut.hint("merge"), same & within)
        if hot_cut.count() <= BROADCAST_ROWS:
            hot_hits = asked.join(F.broadcast(hot_cut), same & within)
        else:
            salted = asked.withColumn("_salt", F.pmod("row", F.lit(SALTS)))
            copies = hot_cut.withColumn("_of", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
            hot_hits = salted.join(copies.hint("merge"), same & (F.col("_salt") == F.col("_of")) & within)
        hits = hits.unionByName(hot_hits.select(hits.columns))
    best = F.min_by(F.struct("pattern", "since"), "_nth")
    found = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_entries"), best.alias("_best"))
    return rows.join(found, "row", "left").select(
        "key", "host", "at", F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.col("_best.pattern").alias("entry"), F.col("_best.since").alias("since"))
