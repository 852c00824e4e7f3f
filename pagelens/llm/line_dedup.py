"""Fuzzy line deduplication by MinHash, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import components, cut, drop_cut, free_shuffles, unused


@dataclass(frozen=True)
class LineParams:
    """``least_chars``: shorter lines are always kept. ``gram``: characters of a
    shingle compared in the end. ``long_gram``: characters of the shingles that
    are hashed where words are few; elsewhere a hashed shingle runs from a
    word's start to the next word's end. ``minima``: smallest hashes of a line;
    each two of them are a band. ``percent``: least Jaccard similarity, in
    hundredths. ``leaders``: lines of a band that the others meet first. ``broadcast_rows``: most rows of two
    or three numbers that are broadcast rather than shuffled; ``broadcast_bytes``
    the same of rows with lists. ``square``: lines of a crowded band that one
    task pairs at a time. ``long_line``: lines of more characters get a wider
    sketch besides."""

    least_chars: int = 10
    gram: int = 5
    long_gram: int = 12
    minima: int = 5
    percent: int = 80
    leaders: int = 8
    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 64 << 20
    square: int = 1024
    long_line: int = 1500


#: Numbers of 64 cells in a sketch, and in that of a long line besides.
WORDS, WIDE = 16, 256
MARKS = ("n", *(f"s{k}" for k in range(WORDS)), "wide")


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def minima(line: Column, p: LineParams) -> Column:
    """The smallest hashes of the line's shingles: from a word's start to the next word's end, or runs of characters where words are few."""
    begun = lambda words: F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    dense = F.regexp_extract_all(line, F.lit(rf"(?=(.{{{p.long_gram}}}))"), F.lit(1))
    few = F.transform(F.when(F.length(line) >= p.long_gram, dense).otherwise(F.array(line)), lambda g: F.xxhash64(g))
    grams = once(F.split(line, " "), lambda w: F.when(F.size(w) * 2 * p.long_gram >= F.length(line), begun(w)).otherwise(few))
    return F.slice(F.sort_array(F.array_distinct(grams)), 1, p.minima)


def bands(m: Column, p: LineParams) -> Column:
    """A key for each two minima, or for the only one."""
    at = lambda k: F.get(m, F.lit(k))
    pairs = [F.when(F.size(m) > j, F.xxhash64(at(i), at(j))) for j in range(1, p.minima) for i in range(j)]
    return F.when(F.size(m) == 1, m).otherwise(F.array_compact(F.array(*pairs)))


def shingles(line: Column, p: LineParams) -> Column:
    """Hashes of all runs of ``gram`` characters; a shorter line is one shingle. Fixed-width code units keep this linear."""
    last = F.length(line) - p.gram
    runs = lambda units: F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.substring(units, 2 * i + 1, F.lit(2 * p.gram))))
    return F.array_distinct(once(F.encode(line, "UTF-16BE"), runs))


def sketches(texts: DataFrame, p: LineParams) -> DataFrame:
    """``h, n, s0.., wide``: of each line the number of its shingles, and the parities of how many of their hashes fall into each cell.

    A sketch tells sets apart while its cells are not far fewer than their
    hashes, hence the wider one of long lines (others have none).
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("g").bitwiseAND(F.lit(63)).cast("int"))
    spot = lambda words: F.shiftrightunsigned("g", 6).bitwiseAND(F.lit(words - 1)).cast("int")
    each = texts.select("h", F.explode(shingles(F.col("line"), p)).alias("g")).select("h", bit.alias("bit"), spot(WORDS).alias("word"))
    short = each.groupBy("h").agg(F.count("*").cast("int").alias("n"), *(F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(WORDS)))
    long = texts.where(F.length("line") > p.long_line)
    words = long.select("h", F.explode(shingles(F.col("line"), p)).alias("g")).select("h", spot(WIDE).alias("word"), bit.alias("bit"))
    empty = long.select("h", F.explode(F.sequence(F.lit(0), F.lit(WIDE - 1))).alias("word"), F.lit(0).cast("long").alias("bit"))
    words = words.union(empty).groupBy("h", "word").agg(F.bit_xor("bit").alias("x"))
    long = words.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("word", "x"))).alias("x")).select("h", F.col("x.x").alias("wide"))  # WIDE numbers a line
    return short.join(long, "h", "left")


def near(a: str, b: str, p: LineParams) -> Column:
    """Whether sizes and sketches allow a link: two sets differ in no fewer hashes than odd cells of both."""
    odd = apart(a, b)
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    few = lambda odd: odd * (100 + p.percent) <= (n + m) * (100 - p.percent)
    wide = F.aggregate(F.zip_with(f"{a}wide", f"{b}wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * p.percent) & few(odd) & F.when(F.col(f"{a}wide").isNull() | F.col(f"{b}wide").isNull(), True).otherwise(few(wide))


def apart(a: str, b: str) -> Column:
    """In how many hashes two sets differ at least: the odd cells of both sketches."""
    return sum((F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))) for k in range(1, WORDS)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))


def linked(pairs: DataFrame, texts: DataFrame, p: LineParams) -> DataFrame:
    """Those of the table ``pairs(a, b)`` whose whole shingle sets are similar enough, as a table."""
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", shingles(F.col("x"), p).alias("x"), shingles(F.col("y"), p).alias("y"))
    counted = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("i"))
    return cut(counted.where(F.col("i") * 100 >= (F.col("m") + F.col("n") - F.col("i")) * p.percent).select("a", "b"))


def led(banded: DataFrame, p: LineParams) -> DataFrame:
    """``a, b``: of each line the nearest and the first of the leaders of its bands with which it may link.

    About ``leaders`` lines of a band lead it, all of a smaller one. The first
    one joins a group of lines that are all alike into one star.
    """
    chosen = banded.where(F.pmod(F.xxhash64("h"), F.col("m")) < p.leaders)
    other = chosen.select("band", *(F.col(c).alias(f"o_{c}") for c in ("h", *MARKS)))
    met = banded.join(other, "band").where((F.col("h") != F.col("o_h")) & near("", "o_", p)).select("h", "o_h", apart("", "o_").alias("odd"))
    best = met.groupBy("h").agg(F.min(F.struct("odd", "o_h")).alias("nearest"), F.min("o_h").alias("first"))
    ends = best.select("h", F.explode(F.array("nearest.o_h", "first")).alias("o"))
    return ends.select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b")).distinct()


def across(meeting: DataFrame, marks: DataFrame, roots: DataFrame, p: LineParams) -> DataFrame:
    """``a, b``: pairs of lines of a band in different components that sizes and sketches allow to link.

    A crowded band is cut into parts, and each two parts meet in a group of
    their own.
    """
    rooted = cut(meeting.select("band", "h").join(small(roots.toDF("h", "r"), p), "h", "left").withColumn("r", F.coalesce("r", "h")))
    mixed = cut(rooted.groupBy("band").agg(F.min("r").alias("x"), F.max("r").alias("y"), F.ceil(F.count("*") / p.square).cast("int").alias("parts")).where("x < y").select("band", "parts"))
    labelled = rooted.join(small(mixed, p), "band").join(marks, "h")
    part = F.pmod(F.xxhash64("h", F.lit(1)), F.col("parts")).cast("int").alias("part")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least("part", t).alias("i"), F.greatest("part", t).alias("j")))
    cells = labelled.select("band", "h", "r", "parts", *MARKS, part).select("band", F.inline(meets), "part", "h", "r", *MARKS)
    other = cells.select(*(F.col(c).alias(f"o_{c}") for c in cells.columns))
    parted = (F.col("h") < F.col("o_h")) & (F.col("r") != F.col("o_r")) & ((F.col("i") == F.col("j")) | (F.col("part") != F.col("o_part")))
    group = (F.col("band") == F.col("o_band")) & (F.col("i") == F.col("o_i")) & (F.col("j") == F.col("o_j"))
    out = cut(cells.join(other, group & parted & near("", "o_", p)).select(F.col("h").alias("a"), F.col("o_h").alias("b")).distinct())
    drop_cut(rooted)
    drop_cut(mixed)
    return out


def small(df: DataFrame, p: LineParams) -> DataFrame:
    """``df``, of two or three numbers a row, broadcast if it is counted to be small; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def with_lines(docs: DataFrame) -> DataFrame:
    return docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("id", "th", "pos", normal(F.col("raw")).alias("line"))


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", params: LineParams = LineParams()) -> DataFrame:
    """``id, th, removed``: the places (from 0) of each document's lines to remove; ``th`` is the text's hash.

    Two lines link when the Jaccard similarity of their character shingles is at
    least ``percent``; case and blanks at the ends do not count. Of each
    component of links the line at the smallest (id, place) stays. Lines under
    ``least_chars`` characters, and documents with a null id or text, take no
    part. Rows that repeat both id and text are one document. Equal lines are
    one node, named by a 64-bit hash; a second hash of 64 bits tells when two
    lines share a name, and then both stay. Counts are combined before each
    shuffle. The lines of a band first meet leaders drawn at random; then those
    still in different components meet each other, so that only pairs which
    could add no link are left out.
    """
    p = params
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    known = with_lines(docs).where(F.length("line") >= p.least_chars)
    lines = cut(known.select("id", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), minima(F.col("line"), p).alias("m")))
    each = lines.groupBy("h").agg(F.min(F.struct("id", "th", "pos")).alias("at"), F.count("*").alias("n"), F.min("g").alias("g"), F.max("g").alias("g2"), F.first("m").alias("m"))
    uniq = cut(each.where("g = g2").drop("g", "g2"))
    keyed = uniq.select("h", F.explode(bands(F.col("m"), p)).alias("band"))
    shared = cut(keyed.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"))
    meeting = cut(keyed.join(small(shared, p), "band"))
    wanted = cut(meeting.select("h").distinct())
    texts = known.select(F.xxhash64("line").alias("h"), "line").join(small(wanted, p), "h", "left_semi")
    texts = cut(texts.groupBy("h").agg(F.first("line").alias("line")))
    marks = cut(sketches(texts, p))
    for done in (shared, wanted):
        drop_cut(done)
    free_shuffles(df.sparkSession)

    pairs = cut(led(meeting.join(marks, "h"), p))
    free_shuffles(df.sparkSession)
    links = linked(pairs, texts, p)
    rest = cut(across(meeting, marks, components(links), p).join(pairs, ["a", "b"], "left_anti"))
    free_shuffles(df.sparkSession)
    roots = components(links.union(linked(rest, texts, p)))
    for done in (meeting, marks, pairs, rest, texts, links):
        drop_cut(done)
    owned = uniq.select("h", "at", "n").join(roots.withColumnRenamed("id", "h"), "h", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "h"))
    owned = cut(owned.select("h", "at", "root"))
    keeper = owned.groupBy("root").agg(F.min("at").alias("keep"))
    doomed = cut(owned.join(keeper, "root").select("h", "keep"))
    free_shuffles(df.sparkSession)
    gone = lines.select("id", "th", "pos", "h").join(small(doomed, p), "h").where(F.struct("id", "th", "pos") != F.col("keep"))
    return gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("removed"))  # a document's own lines at most


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", out: str | None = None, params: LineParams = LineParams()) -> DataFrame:
    """``df`` with repeated lines taken out of ``text`` (into column ``out`` if named), and ``n_lines``, ``n_removed``.

    Documents stay, even where no line is left (their text is then empty); a
    null text stays null with 0 lines. Existing columns of the output names are
    replaced, all others stay, whatever they are called. See ``duplicate_lines``
    for what counts as repeated.
    """
    own_id, own_th, gone, parts = (unused(x, df) for x in ("line_id", "line_th", "line_gone", "line_parts"))
    dead = cut(duplicate_lines(df, id_col, text, params).toDF("i", "t", gone))
    size = dead.agg(F.sum(F.size(gone) * 4 + 48)).first()[0] or 0
    dead = F.broadcast(dead) if size <= params.broadcast_bytes else dead
    names = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed", (out or "").lower())]
    rows = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{id_col}`").cast("long").alias(own_id), F.xxhash64(F.col(f"`{text}`")).alias(own_th))
    joined = rows.join(dead.withColumnsRenamed({"i": own_id, "t": own_th}), [own_id, own_th], "left")
    body = F.col(f"`{text}`")
    joined = joined.withColumn(parts, F.split(body, "\n"))  # once, not for each line that is fetched from it
    lines = F.col(parts)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone).cast("array<int>"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    kept = [F.col(f"`{c}`") for c in names if c != (out or text)]
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    n_removed = F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")
    return joined.select(*kept, F.when(F.col(gone).isNull(), body).otherwise(left).alias(out or text), n_lines, n_removed)
