"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history of dated entries: a rule was added or removed on a day.
Entries become validity intervals, one table for all lists.  Every capture is
joined with the rules that its URL could match, and of each rule's history with
the one interval that holds at its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of each interval, between which the captures of a frequent host are dealt.
SALT = 16


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) from entries (list, kind, pattern, action, at).

    An 'add' holds from its time until the next 'remove' of the same rule, or
    without end (until is null).  A second 'add' while a rule holds changes
    nothing, nor does a 'remove' while it doesn't.  Of entries at one time the
    removal counts last.  Entries with a null in any of these columns, or with
    another action, are left out.
    """
    rule = ["list", "kind", "pattern"]
    e = entries.select(*rule, "action", "at").dropna().where("action in ('add', 'remove')")
    w = Window.partitionBy(*rule).orderBy("at", "action")
    turns = e.withColumn("was", F.lag("action").over(w)).where("action = 'add' and coalesce(was, 'remove') = 'remove' or action = 'remove' and was = 'add'")
    spans = turns.withColumn("until", F.lead("at").over(w)).where("action = 'add'")
    return spans.select(*rule, F.col("at").alias("since"), "until").where("until is null or until > since")


def host_of(url: str = "url") -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)", 2)


def rule_keys(url: str = "url", slashes: str | None = None) -> Column:
    """Every (kind, pattern) that could match a URL.

    ``domain``: the host and each parent of it.  ``prefix``: the host with
    each leading part of the path, up to and with a slash, and the whole of
    it.  ``word``: each run of letters and digits of host and path.
    ``slashes``: SQL for the most slashes that any prefix rule has; leading parts with more match none and are not made.
    """
    u = f"lower(coalesce({url}, ''))"
    host = r"regexp_extract(" + u + r", '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)"
    path = r"regexp_extract(" + u + r", '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    most = f"size(split({path}, '/'))" if slashes is None else f"least(size(split({path}, '/')), coalesce({slashes}, 0) + 1)"
    return F.expr(
        f"""CASE WHEN {host} = '' THEN cast(array() AS array<struct<kind:string,pattern:string>>) ELSE concat(
            transform(sequence(1, size(split({host}, '[.]'))), i -> named_struct('kind', 'domain', 'pattern', array_join(slice(split({host}, '[.]'), i, size(split({host}, '[.]'))), '.'))),
            transform(array_distinct(transform(sequence(1, {most}), i -> concat({host}, array_join(slice(split({path}, '/'), 1, i), '/'), if(i < size(split({path}, '/')), '/', '')))), p -> named_struct('kind', 'prefix', 'pattern', p)),
            transform(array_distinct(filter(split(concat({host}, {path}), '[^a-z0-9]+'), x -> x <> '')), x -> named_struct('kind', 'word', 'pattern', x))
        ) END"""
    )


def matches(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """(key, list, kind, pattern): the rules that hold for each capture when it was fetched.

    A null time or a URL without a host matches nothing; captures are told
    apart by their key, so repeated rows give a match once.  Extra columns of
    either table play no part.
    """
    held = intervals(entries).select("kind", "pattern", "list", "since", "until", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    most = entries.where("kind = 'prefix'").agg(F.max(F.expr("char_length(pattern) - char_length(replace(pattern, '/', ''))"))).first()[0] or 0
    c = captures.select(F.col(key).alias("key"), F.col(at).alias("at"), F.inline(rule_keys(url, str(most))))
    c = c.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    met = c.join(held, ["kind", "pattern", "salt"]).where("since <= at and (until is null or at < until)")
    return met.select(F.col("key").alias(key), "list", "kind", "pattern").distinct()


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """A row for each capture: key, host, time, ``n_rules``, ``lists`` (names in order, comma between) and ``blocked``."""
    per = matches(captures, entries, key, url, at).groupBy(key).agg(F.count("*").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    base = captures.select(F.col(key), host_of(url).alias("host"), F.col(at))
    out = base.join(per.withColumnRenamed(key, "key_of_it"), F.col(key).eqNullSafe(F.col("key_of_it")), "left").drop("key_of_it")
    return out.select(key, "host", at, F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_rules").isNotNull().alias("blocked"))
