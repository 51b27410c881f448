"""Line dedup: lines that stand in too many documents go, the rest is put together again by position."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import fresh, set_text, settled

#: The blanks besides the space.
BLANKS = "\t\r\f\x0b\xa0"
SPACE = f"[ {BLANKS}]+"
#: At most this many frequent lines (32 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_LINES = 1_000_000

_K1, _K2, _H1, _H2, _POS, _DOC, _FIRST, _DROP = "k1 k2 h1 h2 pos doc first drop".split()


def normalised(line: Column) -> Column:
    """Lower case, runs of blanks as one space, none at the ends. Only lines with something to replace go through the pattern."""
    odd = functools.reduce(lambda a, b: a | b, (F.contains(line, F.lit(x)) for x in ("  ", *BLANKS)))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line)))


def _keys() -> tuple[Column, Column]:
    """A 128-bit key of (doc_id, text) names a row without moving its text."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text"))


def _exploded(docs: DataFrame) -> DataFrame:
    k1, k2 = _keys()
    rows = docs.where("text != ''").select(k1.alias(_K1), k2.alias(_K2), F.col("doc_id").alias(_DOC), F.posexplode(F.split("text", "\n")).alias(_POS, "line"))
    rows = rows.withColumn("line", normalised(F.col("line"))).where("line != ''")
    return rows.select(_K1, _K2, _DOC, _POS, F.xxhash64("line").alias(_H1), F.xxhash64(F.lit(1), F.col("line")).alias(_H2))


def frequent_lines(docs: DataFrame, max_docs: int) -> DataFrame:
    """128-bit hashes of the lines that more than ``max_docs`` documents have, each with the least such doc_id."""
    many = F.count_distinct(_DOC) + F.max(F.col(_DOC).isNull().cast("int")) > max_docs
    return _exploded(docs).groupBy(_H1, _H2).agg(F.min(_DOC).alias(_FIRST), many.alias("many")).where("many").drop("many")


def _without(docs: DataFrame, max_docs: int, keep_first: bool, dropped: str) -> DataFrame:
    """``docs`` without frequent lines, and the number that went in a new column ``dropped``."""
    frequent = settled(frequent_lines(docs, max_docs))
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    found = _exploded(docs).join(frequent, [_H1, _H2])
    if keep_first:
        found = found.where(~F.col(_DOC).eqNullSafe(F.col(_FIRST)))
    k1, k2, drop, split = fresh(docs, "__line_dedup_k1", "__line_dedup_k2", "__line_dedup_drop", "__line_dedup_lines")
    drops = found.groupBy(F.col(_K1).alias(k1), F.col(_K2).alias(k2)).agg(F.collect_set(_POS).alias(drop))
    out = docs.withColumns(dict(zip((k1, k2), _keys(), strict=True))).join(drops, [k1, k2], "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n"))
    out = set_text(out.withColumn(split, F.when(F.col(drop).isNotNull(), lines)), text)
    return out.withColumn(dropped, F.coalesce(F.size(F.col(drop)), F.lit(0)).cast("bigint")).drop(k1, k2, drop, split)


def line_dedup(docs: DataFrame, max_docs: int = 10, keep_first: bool = True) -> DataFrame:
    """``docs`` without lines that stand in more than ``max_docs`` distinct documents.

    Lines are split at ``\\n`` and compared after :func:`normalised`. With ``keep_first`` the document with the least
    doc_id keeps such a line, so that nothing goes from the corpus altogether; without it the line goes everywhere.
    All columns stay; ``text`` and ``n_chars`` change, and ``lines_dropped`` (bigint) is appended, in place of a
    column of that name.

    Null text stays null and empty text empty, with 0 lines dropped. Blank lines are never dropped. A document is
    a distinct doc_id; rows without a doc_id count as one document together, and never as the first if another has
    the line. Repeated rows count once and are treated alike. A line that a document repeats counts once, and all
    its places go. An empty table gives an empty table.
    """
    return _without(docs.drop("lines_dropped"), max_docs, keep_first, "lines_dropped")


def stage(docs: DataFrame, max_docs: int = 10) -> DataFrame:
    """:func:`line_dedup` for the pipeline: documents of which no line is left, all being kept elsewhere, go. Other columns stay as they are."""
    (dropped,) = fresh(docs, "__line_dedup_dropped")
    return _without(docs, max_docs, True, dropped).where((F.col(dropped) == 0) | (F.trim("text") != "")).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text <> ''),
n AS (SELECT *, lower(trim(regexp_replace(line, '[ \t\r\f\x0b\x{a0}]+', ' ', 'g'))) AS norm FROM l),
b AS (SELECT norm, min(doc_id) AS keeper FROM n WHERE norm <> '' GROUP BY norm
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > 10),
m AS (SELECT n.rid, n.line, n.pos, b.norm IS NOT NULL AND n.doc_id IS DISTINCT FROM b.keeper AS gone
      FROM n LEFT JOIN b ON n.norm = b.norm),
g AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
             count(*) FILTER (WHERE gone) AS lines_dropped FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(g.text, d.text) AS text, coalesce(g.lines_dropped, 0) AS lines_dropped
FROM d LEFT JOIN g USING (rid)
"""
