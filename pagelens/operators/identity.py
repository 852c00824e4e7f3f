"""Durable element identity and changes between snapshots."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.session import stored

RUNGS = ("testid", "id", "named-control", "role-name-scoped", "role-name-landmark")


def anchor_keys(anchor: str = "anchor") -> Column:
    """``array<struct<rung,kind,key>>``, strongest first; a missing attribute gives no key and ordinals are in none."""
    a = lambda f: F.nullif(F.col(f"{anchor}.{f}"), F.lit(""))
    place = F.concat_ws("|", F.coalesce(a("page_key"), F.lit("")), F.coalesce(a("landmark"), F.lit("")), F.coalesce(a("landmark_label"), F.lit("")))
    made = {
        "testid": F.when(a("attr_testid").isNotNull(), F.concat(place, F.lit("|"), a("attr_testid"))),
        "id": F.when(a("attr_id").isNotNull(), F.concat(place, F.lit("|"), a("attr_id"))),
        "named-control": F.when(a("role").isNotNull() & a("attr_name").isNotNull(), F.concat(place, F.lit("|"), a("role"), F.lit("|"), a("attr_name"))),
        "role-name-scoped": F.when(a("role").isNotNull() & a("name").isNotNull() & a("labelled_ancestor").isNotNull(), F.concat(place, F.lit("|"), a("role"), F.lit("|"), a("name"), F.lit("|"), a("labelled_ancestor"))),
        "role-name-landmark": F.when(a("role").isNotNull() & a("name").isNotNull(), F.concat(place, F.lit("|"), a("role"), F.lit("|"), a("name"))),
    }
    return F.filter(F.array(*(F.struct(F.lit(k).alias("rung"), F.lit(name).alias("kind"), key.alias("key")) for k, (name, key) in enumerate(made.items()))), lambda x: x["key"].isNotNull())


def unique_keys(units: DataFrame) -> DataFrame:
    """Exploded keys of ``units(handle, token, ref, kind, anchor)`` that no other unit of the same read and kind has."""
    rows = units.select("handle", "token", "ref", F.col("kind").alias("unit_kind"), F.explode(anchor_keys()).alias("k")).select("handle", "token", "ref", "unit_kind", "k.rung", F.col("k.kind").alias("key_kind"), "k.key")
    n = F.count("*").over(W.partitionBy("handle", "token", "unit_kind", "key_kind", "key"))
    return rows.withColumn("n", n).where("n = 1").drop("n")


def bind_refs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bind units of a later read to refs of an earlier one: ``new_ref, ref`` by the strongest unique key both have.

    One equi-join per rung, strongest first; what is bound already, on either
    side, takes no further part. Units without a partner have a null ``ref``.
    """
    old, new = unique_keys(before), unique_keys(after)
    bound = None
    for rung in range(len(RUNGS)):
        o = old.where(F.col("rung") == rung).select("handle", "unit_kind", "key", F.col("ref").alias("old_ref"))
        n = new.where(F.col("rung") == rung).select("handle", "unit_kind", "key", F.col("ref").alias("new_ref"))
        if bound is not None:
            o = o.join(bound.select("handle", F.col("ref").alias("old_ref")), ["handle", "old_ref"], "left_anti")
            n = n.join(bound.select("handle", "new_ref"), ["handle", "new_ref"], "left_anti")
        hit = o.join(n, ["handle", "unit_kind", "key"]).select("handle", "new_ref", F.col("old_ref").alias("ref"), F.lit(RUNGS[rung]).alias("by"))
        bound = hit if bound is None else bound.unionByName(hit)
    return after.select("handle", F.col("ref").alias("new_ref")).join(bound, ["handle", "new_ref"], "left")


def mark_gone(before: DataFrame, after: DataFrame) -> DataFrame:
    """Refs of full earlier reads that the later read lacks, with their last role and name."""
    return before.where(~F.coalesce("scoped", F.lit(False))).join(after.select("handle", "ref"), ["handle", "ref"], "left_anti").select("handle", "ref", F.col("anchor.role").alias("role"), F.col("anchor.name").alias("name"))


def resolve_refs(asked: DataFrame, registry: DataFrame, current: DataFrame, state: DataFrame, across_urls: bool = False) -> DataFrame:
    """``handle, ref, outcome, tier, now``: what each asked ref means on its page as it is now.

    ``asked(handle, ref)``; ``registry(ref, minted_on, url, turn_local, gone,
    role, name, landmark, landmark_label, key)``, one row per ref ever minted;
    ``current(handle, ref, role, name, landmark, landmark_label, key)``, the
    units of each page now; ``state(handle, url, modal)``, a row per page. In
    order: ``MODAL`` behind a dialog, ``NOT_FOUND`` if never minted,
    ``BAD_PARAMS`` if minted on another page, ``STALE`` if the URL moved (unless
    ``across_urls``), ``AMBIGUOUS`` for a ref that nothing told apart, ``OK`` on
    a single key hit of equal role and name, ``REBOUND`` on one with another
    name, else on a single match of role and name in the landmark, then anywhere
    on the page; ``AMBIGUOUS`` on several, ``STALE`` on none. A key hit of another
    role, or for a ref marked gone, does not count. Matches never leave the page:
    all joins are on the handle, and units are counted before they are joined.
    """
    place = ["landmark", "landmark_label"]
    one = lambda *keys: current.groupBy("handle", *keys).agg(F.count("*").alias("n"), F.min(F.struct("ref", "role", "name")).alias("hit"))
    entry = asked.join(registry, "ref", "left").join(state.select("handle", F.col("url").alias("now_url"), "modal"), "handle", "left")
    keyed = one("key").where("key is not null").select("handle", "key", F.col("n").alias("key_n"), F.col("hit").alias("key_hit"))
    near = one("role", "name", *place).select("handle", "role", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in place), F.col("n").alias("near_n"), F.col("hit.ref").alias("near_ref"))
    near = near.groupBy("handle", "role", "name", *place).agg(F.sum("near_n").alias("near_n"), F.min("near_ref").alias("near_ref"))
    wide = one("role", "name").select("handle", "role", "name", F.col("n").alias("any_n"), F.col("hit.ref").alias("any_ref"))
    j = entry.withColumns({c: F.coalesce(c, F.lit("")) for c in place}).join(keyed, ["handle", "key"], "left").join(near, ["handle", "role", "name", *place], "left").join(wide, ["handle", "role", "name"], "left")
    hit = (F.col("key_n") == 1) & ~F.coalesce("gone", F.lit(False)) & (F.col("key_hit.role") == F.col("role"))
    steps = (
        (F.coalesce("modal", F.lit(False)), "MODAL", "modal", None),
        (F.col("minted_on").isNull(), "NOT_FOUND", "never minted", None),
        (F.col("minted_on") != F.col("handle"), "BAD_PARAMS", "another page", None),
        (~F.lit(across_urls) & (F.col("url") != F.col("now_url")), "STALE", "url-changed", None),
        (F.coalesce("turn_local", F.lit(False)), "AMBIGUOUS", "turn-local ref", None),
        (hit & (F.col("key_hit.name") == F.col("name")), "OK", "key", F.col("key_hit.ref")),
        (hit, "REBOUND", "key, name changed", F.col("key_hit.ref")),
        (F.col("near_n") == 1, "REBOUND", "role and name in landmark", F.col("near_ref")),
        (F.col("near_n") > 1, "AMBIGUOUS", "role and name in landmark", None),
        (F.col("any_n") == 1, "REBOUND", "role and name anywhere", F.col("any_ref")),
        (F.col("any_n") > 1, "AMBIGUOUS", "role and name anywhere", None),
        (F.lit(True), "STALE", "no match", None),
    )
    outcome = F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(o).alias("outcome"), F.lit(t).alias("tier"), (F.lit(None) if now is None else now).cast("string").alias("now"))) for test, o, t, now in steps))
    return j.select("handle", "ref", outcome.alias("o")).select("handle", "ref", "o.*")


#: Prefixes grow until there are this many times as many of them, and at one of so many lengths; how many the first walk keeps for an asked name.
FAN, CUTS, KEPT = 10, 128, 2


def prefix_lengths(names: DataFrame) -> list[int]:
    """Lengths at which prefixes of ``names(name, long)`` are told apart, about ``FAN`` times as many each time; the last is that of the longest name."""
    longest = names.agg(F.max("long")).first()[0] or 0
    cuts = sorted({*range(1, longest, -(-longest // CUTS) or 1), longest})
    seen = names.agg(*(F.approx_count_distinct(F.left("name", F.lit(p))) for p in cuts)).first()
    out, before = [], 1
    for k, p in enumerate(cuts):
        if p == longest or seen[k + 1] > FAN * before:
            out.append(p)
            before = seen[k]
    return out


def nearest_by_name(asked: DataFrame, current: DataFrame, least: float = 0.4) -> DataFrame:
    """The most similar name of the same page for each asked one: one less the edit distance over the longer length; of equally similar names the last.

    Names are not paired with all of their page. Prefixes of current names, apart
    by the length of the name, grow a few characters a step; no edit distance of
    a name is below that of its prefix to a prefix of the asked name plus the
    difference of what is left of both. A first walk that keeps the best prefixes
    alone ends at some names of the page; the second keeps every prefix that can
    still be as similar, ties included. Where nothing can be ruled out, that is
    all pairs after all.
    """
    spark = current.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = stored(current.select("handle", "name").where("handle is not null and name is not null").distinct().withColumn("long", F.length("name")))
    sought = stored(asked.select("handle", F.col("name").alias("asked_name")).where("handle is not null and asked_name is not null").distinct())
    key = ["handle", "long", "at"]
    size = F.length("asked_name")
    left = F.col("long") - F.length("to")
    edits = F.array_min(F.transform(F.sequence(F.lit(0), size), lambda j: F.levenshtein(F.substring(F.col("asked_name"), F.lit(1), j), F.col("to")) + F.abs(size - j - left)))
    most = (1 - edits / F.greatest(size, F.col("long"), F.lit(1))).alias("most")

    def grown(front: DataFrame, had: int, has: int) -> DataFrame:
        """``front`` with the prefixes ``to`` of ``has`` characters that go on from ``at``; explicit numbers, for few rows may cost much."""
        longer = names.select("handle", "long", F.left("name", F.lit(had)).alias("at"), F.left("name", F.lit(has)).alias("to")).distinct()
        return front.drop("most").repartition(n, *key).join(longer.repartition(n, *key).hint("merge"), key)

    lengths = names.select("handle", "long").distinct()
    levels = list(pairwise([0, *prefix_lengths(names)]))
    front = sought.join(lengths, "handle").withColumn("at", F.lit(""))
    for had, has in levels:
        place = F.row_number().over(W.partitionBy("handle", "asked_name").orderBy(F.desc("most"), "to", "long"))
        best = grown(front, had, has).select("handle", "asked_name", "long", F.col("to"), most).withColumn("place", place).where(F.col("place") <= KEPT)
        front = best.select("handle", "asked_name", "long", F.col("to").alias("at"), "most")
    floor = stored(front.groupBy("handle", "asked_name").agg(F.greatest(F.max("most"), F.lit(least)).alias("floor")))
    front = floor.join(lengths, "handle").withColumn("at", F.lit(""))
    for had, has in levels:
        front = grown(front, had, has).where(most >= F.col("floor")).select("handle", "asked_name", "floor", "long", F.col("to").alias("at"))
    ratio = 1 - F.levenshtein("asked_name", "at") / F.greatest(size, F.col("long"), F.lit(1))
    return front.groupBy("handle", "asked_name").agg(F.max(F.struct(ratio.alias("ratio"), F.col("at").alias("name"))).alias("b")).select("handle", "asked_name", F.col("b.name").alias("name"), F.col("b.ratio").alias("ratio"))


def snapshot_diff(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = ("name", "landmark", "landmark_label", "state")) -> DataFrame:
    """Refs ``added``, ``removed`` or ``changed`` (with the fields) between two snapshots keyed by (handle, ref); stable ones are left out.

    Units marked ``turn_local`` get a new ref with every read; they are neither
    added nor removed.
    """
    sticky = lambda d: d.where(~F.coalesce("turn_local", F.lit(False))) if "turn_local" in d.columns else d
    b = sticky(before).select("handle", "ref", F.struct(*fields).alias("b"))
    a = sticky(after).select("handle", "ref", F.struct(*fields).alias("a"))
    j = b.join(a, ["handle", "ref"], "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.select("handle", "ref", change.alias("change"), F.when(change == "changed", F.array_join(changed, ",")).alias("fields")).where("change is not null")


def delta_summary(before: DataFrame, after: DataFrame, urls: DataFrame, fields: tuple[str, ...] = ("name", "landmark", "landmark_label", "state")) -> DataFrame:
    """``handle, added, removed, changed, stable, stable_by_kind, re_minted, navigated``: what two reads of each page have in common and what not.

    Snapshots as for ``snapshot_diff``, with ``kind`` and ``turn_local``;
    ``urls(handle, url_before, url_after)`` has a row for each page. Units that
    nothing tells apart are counted as ``re_minted`` if the later read has them
    under a ref that the earlier one lacks.
    """
    b = before.select("handle", "ref", F.struct(*fields).alias("b"), F.coalesce("turn_local", F.lit(False)).alias("b_local"))
    a = after.select("handle", "ref", F.struct(*fields).alias("a"), F.coalesce("turn_local", F.lit(False)).alias("a_local"), "kind")
    j = b.join(a, ["handle", "ref"], "full")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))
    old, new = F.col("b").isNotNull(), F.col("a").isNotNull()
    counts = j.groupBy("handle").agg(F.count_if(~old & ~F.col("a_local")).alias("added"), F.count_if(~new & ~F.col("b_local")).alias("removed"), F.count_if(old & new & ~same).alias("changed"), F.count_if(old & new & same).alias("stable"), F.count_if(~old & F.col("a_local")).alias("re_minted"))
    kinds = j.where(old & new & same).groupBy("handle", "kind").agg(F.count("*").alias("n")).groupBy("handle").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ", ").alias("stable_by_kind"))
    told = urls.select("handle", (~F.col("url_before").eqNullSafe(F.col("url_after"))).alias("navigated"))
    out = told.join(counts, "handle", "left").join(kinds, "handle", "left").na.fill(0, ["added", "removed", "changed", "stable", "re_minted"])
    return out.select("handle", "added", "removed", "changed", "stable", F.coalesce("stable_by_kind", F.lit("")).alias("stable_by_kind"), "re_minted", "navigated")


def retain_reads(reads: DataFrame, keep: int = 5) -> DataFrame:
    """Reads of each handle with ``retained`` for the newest ``keep``."""
    n = F.row_number().over(W.partitionBy("handle").orderBy(F.desc("ts"), F.desc("token")))
    return reads.withColumn("age", n).withColumn("retained", F.col("age") <= keep).withColumn("reason", F.when(F.col("age") > keep, F.lit("older than the newest reads")))


def batch_outcome(items: DataFrame) -> DataFrame:
    """Per batch: completed, rebound, the first failing ref and why, and what was not attempted after it."""
    bad = ~F.col("outcome").isin("OK", "REBOUND")
    first = F.min(F.when(bad, F.col("pos"))).over(W.partitionBy("batch"))
    rows = items.withColumn("first_bad", first)
    done = F.col("first_bad").isNull() | (F.col("pos") < F.col("first_bad"))
    return rows.groupBy("batch").agg(F.count_if(done).alias("completed"), F.count_if(done & (F.col("outcome") == "REBOUND")).alias("rebound"), F.max(F.when(F.col("pos") == F.col("first_bad"), F.struct("ref", "outcome"))).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("first_bad"), F.struct("pos", F.col("ref").cast("string").alias("ref")))))["ref"], ",").alias("not_attempted"))
