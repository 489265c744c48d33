"""Line dedup over ranges of line hashes, in DataFrame operations only.

Lines are known by a 128-bit hash of their key: the line without ASCII white space at its ends, A-Z lower-cased. Narrow
rows (hash, document, position) are exchanged once, by ranges of the hash, and sorted within a range by hash, document
(largest first) and position. One stream over a range then marks each document's first occurrence of a key, counts a
key's documents by these marks, and names the lines that go. What is returned for each document that loses lines is a
bitmap, compressed to the 64-bit words that are not all ones; texts take no part in any exchange but the one, if any,
in which they meet their bitmaps.

Heavy keys, with more rows than ``2**-SHARE_BITS`` of all or than ``ROWS``, are not exchanged. They are found by exact
counts, first of hash cells, then of the keys in cells that are over the limit. Their documents are counted with
map-side combining, and their rows are decided where they lie, by a broadcast of at most ``max(2**SHARE_BITS, rows /
ROWS)`` keys.

Defined cases: a null text is one empty line, as an empty one is; rows that share an id are one document when a key's
documents are counted, and all of them keep the key's lines if theirs is the largest id; null ids are one document,
smaller than all others; a document that holds a key more than once counts once, and loses or keeps all its lines of
that key; an empty table gives an empty result; further columns of any name are kept.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.session import checkpointed, small_side, written

#: White space that is stripped from a line's ends.
SPACE = " \t\n\x0b\x0c\r"
#: A key is heavy with over 2**-SHARE_BITS of all rows (and over LEAST rows), or over ROWS.
SHARE_BITS, LEAST, ROWS = 12, 64, 1_000_000
#: Heavy keys that are broadcast, and bytes of bitmaps, about; beyond, both meet the rows by an ordinary join.
KEYS, BITMAPS = 1_000_000, 32 << 20


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line as it is compared. All of an ASCII text's capitals are A-Z, so the faster ``lower`` does for it."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def occurrences(docs: DataFrame, least_points: int, text: str, key: str) -> DataFrame:
    """(doc, mark, pos, u, v): every line whose key is long enough; mark tells rows of one id apart, (u, v) is the key's hash."""
    found = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(lines(F.col(text))).alias("pos", "line"))
    found = found.filter(F.length(F.btrim("line", F.lit(SPACE))) >= least_points).select("doc", "mark", "pos", line_key(F.col("line")).alias("k"))
    return found.select("doc", "mark", "pos", F.xxhash64("k").alias("u"), F.xxhash64(F.lit("line"), "k").alias("v"))


def heavy_keys(rows: DataFrame, limit: int, total: int) -> DataFrame:
    """(u, v, docs, last) of the keys with over ``limit`` rows: the number of their documents, and the largest id."""
    bits = max(1, min(40, math.ceil(math.log2(max(2.0, 16 * total / limit)))))
    cell = F.shiftrightunsigned("u", 64 - bits)
    cells = checkpointed(rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("cell"))
    among = rows.withColumn("cell", cell).join(small_side(cells, KEYS), "cell", "left_semi")
    keys = checkpointed(among.groupBy("u", "v").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("u", "v"))
    held = rows.join(small_side(keys, KEYS), ["u", "v"], "left_semi").select("u", "v", "doc").distinct()
    return checkpointed(held.groupBy("u", "v").agg(F.count("*").alias("docs"), F.max("doc").alias("last")))


def light_rows(rows: DataFrame) -> DataFrame:
    """Adds docs and last to the rows, by one stream over ranges of the hash."""
    order = Window.partitionBy("u", "v").orderBy(F.desc("doc"), "mark", "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = (F.row_number().over(order) == 1) | ~F.lag("doc").over(order).eqNullSafe(F.col("doc"))
    ranged = rows.repartitionByRange("u", "v").withColumn("first", first.cast("long"))
    return ranged.select("doc", "mark", "pos", F.sum("first").over(whole).alias("docs"), F.first("doc").over(whole).alias("last"))


def line_dedup(docs: DataFrame, least_points: int = 40, least_docs: int = 5, text: str = "text", key: str = "doc_id", heavy: int | None = None) -> DataFrame:
    """(doc, mark, keep, n_dropped) for each document that loses lines.

    keep: structs (word, bits) in order; bit i of word w says whether line 64 * w + i stays; words not named are all
    ones. mark: xxhash64 of the text. heavy: rows over which a key is heavy, if not by the shares above.
    """
    rows = written(occurrences(docs, least_points, text, key), "lines")
    total = rows.count()
    limit = heavy or min(max(total >> SHARE_BITS, LEAST), ROWS)
    known = small_side(heavy_keys(rows, limit, total), KEYS)
    decided = light_rows(rows.join(known, ["u", "v"], "left_anti")).unionByName(rows.join(known, ["u", "v"]).select("doc", "mark", "pos", "docs", "last"))
    gone = decided.filter((F.col("docs") >= least_docs) & ~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "mark", "pos")
    word, bit = (F.col("pos") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)")
    words = gone.repartition("doc", "mark").groupBy("doc", "mark", word).agg(F.bit_or(bit).alias("bits"))
    entry = F.struct("word", F.bitwise_not("bits").alias("bits"))
    return words.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(entry)).alias("keep"), F.sum(F.bit_count("bits")).alias("n_dropped"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined; all of them where it is null."""
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get(keep, j - 1)["word"])
    dense = F.flatten(F.transform(keep, lambda e, j: F.concat(F.array_repeat(F.lit(-1).cast("long"), e["word"] - before(j) - 1), F.array(e["bits"]))))
    stays = lambda j: F.coalesce(F.get(dense, F.floor(j / 64).cast("int")), F.lit(-1).cast("long"))
    left = F.filter(lines(text), lambda line, j: F.getbit(stays(j), j % 64) == 1)
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))


def applied(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents in a struct _doc, with kept (the text that stays), n_lines and n_dropped."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    named = checkpointed(bitmaps.select(F.col("doc").alias("_d"), F.col("mark").alias("_m"), "keep", F.col("n_dropped").alias("_n")))
    size = named.agg(F.sum(48 + 24 * F.size("keep"))).head()[0] or 0
    known = F.broadcast(named) if size <= BITMAPS else named
    text = F.col(f"_doc.`{text}`")
    met = whole.join(known, F.col(f"_doc.`{key}`").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_m")), "left")
    n_lines = F.size(lines(text)).cast("long")
    return met.select("_doc", kept_text(text, F.col("keep")).alias("kept"), n_lines.alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"))
