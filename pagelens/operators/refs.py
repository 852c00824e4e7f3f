"""The registry of refs: every unit of a page keeps its ref from read to read."""

from __future__ import annotations

from collections import Counter
from collections.abc import MutableMapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.fold import ordered_fold
from pagelens.operators.identity import anchor_keys

#: What the units of a read are bound within: a page, a frame of it and a kind of unit.
SCOPE = ["handle", "frame", "kind"]
UNIT = "ord long, ref long, key_kind string, turn_local boolean, minted boolean"
KEYED = "array<struct<ord:bigint,keys:array<struct<rung:int,kind:string,key:string>>>>"


class RefBook:
    """Refs of one scope: ``known`` maps a key to its ref, ``count`` is the last ref minted."""

    def __init__(self, known: MutableMapping[str, int] | None = None, count: int = 0):
        self.known = {} if known is None else known
        self.count = count

    def bind(self, units: list[tuple[int, list[tuple[str, str]]]]) -> list[tuple]:
        """A row of ``UNIT`` for each unit of one read; ``units`` have their ``(kind, key)`` strongest first.

        A key counts only if no other unit of the read has it. The first such key
        whose ref this read has not used yet decides, else a ref is minted; all
        the unit's keys then stand for it. A unit without such a key gets a ref
        for this read alone.
        """
        often = Counter(key for _, keys in units for key in keys)
        used: set[int] = set()
        out = []
        for ord_, keys in units:
            own = [k for k in keys if often[k] == 1]
            ref = by = None
            for kind, key in own:
                prior = self.known.get(f"{kind}:{key}")
                if prior is not None and prior not in used:
                    ref, by = prior, kind
                    break
            minted = ref is None
            if minted:
                self.count += 1
                ref, by = self.count, own[0][0] if own else "turn-local"
            for kind, key in own:
                self.known[f"{kind}:{key}"] = ref
            used.add(ref)
            out.append((ord_, ref, by, not own, minted))
        return out


def reads_of(units: DataFrame) -> DataFrame:
    """Reads of ``units(handle, frame, kind, token, ord, anchor)``: a row for each scope and token, its units with their keys in an array, in order of ``ord``."""
    keyed = units.select(*SCOPE, "token", F.struct(F.col("ord").cast("long").alias("ord"), anchor_keys().alias("keys")).alias("u"))
    return keyed.groupBy(*SCOPE, "token").agg(F.array_sort(F.collect_list("u")).cast(KEYED).alias("units"))


def plain(units) -> list[tuple[int, list[tuple[str, str]]]]:
    """The array of ``reads_of`` as Python sees it, for ``RefBook.bind``."""
    return [(int(u["ord"]), [(k["kind"], k["key"]) for k in u["keys"]]) for u in units]


def bind_reads(units: DataFrame) -> DataFrame:
    """``handle, frame, kind, token, ord, ref, key_kind, turn_local, minted`` for every unit of every read, refs sticky within their scope.

    ``units(handle, frame, kind, token, ord, anchor)``; reads follow each other
    by ``token`` (a number), units within one by ``ord``. Units of different
    frames or kinds never share a ref; refs count from 1 within a scope. Null
    frames are a frame of their own. Each binding rests on those before it: an
    ordered fold over reads, whose state is the keys of one scope.
    """
    reads = reads_of(units)
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}
    rows = reads.select(*SCOPE, "token", "units")
    head = ", ".join(f"{c} {kinds[c]}" for c in (*SCOPE, "token"))
    return ordered_fold(rows, SCOPE, ["token"], RefBook, lambda book, r: [(*r[:4], *x) for x in book.bind(plain(r[4]))], f"{head}, {UNIT}")


def ref_entries(bound: DataFrame, units: DataFrame, scoped: Column | None = None) -> DataFrame:
    """One row per ref of ``bind_reads``: ``minted`` and ``seen`` (its first and last read), last ``key_kind``, ``role``, ``name``, ``turn_local``, ``gone`` and, if so, ``gone_as``.

    A ref is gone if a later full read of its page and frame lacks it; a read
    for which ``scoped`` (a condition on ``units``) holds looked at a part alone
    and makes nothing gone.
    """
    where = [*SCOPE, "token", "ord"]
    told = bound.join(units.select(*where, F.col("anchor.role").alias("role"), F.col("anchor.name").alias("name")), where)
    last = lambda c: F.max_by(c, "token").alias(c)
    entries = told.groupBy(*SCOPE, "ref").agg(F.min("token").alias("minted"), F.max("token").alias("seen"), *map(last, ("key_kind", "role", "name", "turn_local")))
    full = (units if scoped is None else units.where(~F.coalesce(scoped, F.lit(False)))).groupBy("handle", "frame").agg(F.max("token").alias("full_read"))
    gone = F.coalesce(F.col("full_read") > F.col("seen"), F.lit(False))
    kept = entries.join(full.withColumnRenamed("handle", "h").withColumnRenamed("frame", "f"), F.col("handle").eqNullSafe(F.col("h")) & F.col("frame").eqNullSafe(F.col("f")), "left")
    return kept.select(*SCOPE, "ref", "minted", "seen", "key_kind", "turn_local", "role", "name", gone.alias("gone"), F.when(gone, F.concat(F.coalesce("role", F.lit("")), F.lit(' "'), F.coalesce("name", F.lit("")), F.lit('"'))).alias("gone_as"))


def frames_gone(entries: DataFrame, live: DataFrame, why: str) -> DataFrame:
    """``entries`` with the refs of frames that are no longer on their page marked gone; ``live(handle, frame)`` are those that are. The page itself (a null or empty frame) stays."""
    there = live.select("handle", "frame").distinct().withColumn("__there", F.lit(True))
    lost = (F.coalesce("frame", F.lit("")) != "") & F.col("__there").isNull() & ~F.col("gone")
    told = F.concat(F.coalesce("role", F.lit("")), F.lit(' "'), F.coalesce("name", F.lit("")), F.lit('" (in '), F.col("frame"), F.lit(f", {why})"))
    return entries.join(there, ["handle", "frame"], "left").withColumn("gone_as", F.when(lost, told).otherwise(F.col("gone_as"))).withColumn("gone", F.col("gone") | lost).drop("__there")
