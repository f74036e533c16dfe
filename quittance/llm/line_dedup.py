"""Line dedup across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.common import ascii_lower, table

#: Stripped from both ends of a line for its key: space and \t \n \v \f \r.
BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drops lines that many documents hold, except in the smallest ``id_col`` holding them.

    Lines are exploded, normalised and hashed to 128 bits; distinct documents
    are counted per hash in two aggregations that both combine before their
    shuffle, so that a line held by a third of all documents loads no task. The
    hashes over the threshold meet the lines in an equi-join on the pair as one
    key: so both sides are shuffled for the join itself, and adaptive execution
    splits a hot key over many tasks. Texts move once, to meet the
    positions of their dropped lines.

    Returns all columns of ``docs`` with the text replaced by the kept lines,
    plus ``n_lines`` (before dropping) and ``n_dropped``; input columns of these
    two names are replaced.

    Edge cases: a null or empty text is one empty line and becomes an empty
    text; an empty table gives an empty table; rows that share an id count as
    one document, and each of them is kept as a row; a null id is a document of
    its own and comes after all others; text that is all dropped becomes empty.
    """
    rest = docs.drop("n_lines", "n_dropped")
    if id_col not in rest.columns or text_col not in rest.columns:
        raise ValueError(f"documents need {id_col!r} and {text_col!r}")
    doc = rest.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), _lines(F.col(text_col)).alias("lines"))
    hashed = (
        doc.select("doc", "th", F.posexplode("lines").alias("pos", "line"))
        .select("doc", "th", "pos", _key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "th", "pos", F.struct(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")).alias("h"))
    )
    common = (
        hashed.select("h.h1", "h.h2", "doc")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
        .where(F.col("n") >= min_docs)
        .select(F.struct("h1", "h2").alias("h"), "first")
    )
    dropped = (
        hashed.join(common, "h")
        .where(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy("doc", "th")
        .agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    )
    left = rest.withColumns({"__ld_th": F.xxhash64(text_col), "__ld_lines": _lines(F.col(text_col))})
    met = left.join(
        dropped.select(F.col("doc").alias("__ld_doc"), F.col("th").alias("__ld_th2"), F.col("drop").alias("__ld_drop")),
        F.col(id_col).eqNullSafe(F.col("__ld_doc")) & (F.col("__ld_th") == F.col("__ld_th2")),
        "left",
    )
    lines, drop = F.col("__ld_lines"), F.col("__ld_drop")
    n_drop = F.coalesce(F.size(drop), F.lit(0))

    def gap(i: Column) -> Column:
        """The lines between the dropped positions i - 1 and i."""
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(drop, i - 1) + 1)
        end = F.coalesce(F.get(drop, i), F.size(lines))
        return F.slice(lines, begin + 1, end - begin)

    kept = F.when(drop.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), gap)), "\n")
    )
    return met.withColumns({text_col: kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.when(drop.isNull(), F.lit(0)).otherwise(n_drop).cast("long")}).drop(
        "__ld_th", "__ld_lines", "__ld_doc", "__ld_th2", "__ld_drop"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, u.i AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) u),
c AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, l.pos, l.line, (c.key IS NOT NULL AND l.doc_id <> c.first) AS dropped FROM l LEFT JOIN c ON l.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
