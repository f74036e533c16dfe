"""Edit-distance join of names: one side indexes disjoint chunks, the other probes positional q-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement, product
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.common import bounded_batches, cut, table

#: Chunks that an index key holds together.
AGREE = 2
#: Characters of a chunk at least; names too short for that are handled exhaustively.
LEAST_CHUNK = 3


def damerau_levenshtein(a: str, b: str) -> int:
    """The fewest insertions, deletions, substitutions and exchanges of neighbours that turn one text into the other.

    Substrings may be edited again, so this is the unrestricted distance.
    """
    head = len(commonprefix((a, b)))
    tail = min(len(commonprefix((a[::-1], b[::-1]))), len(a) - head, len(b) - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_col = 0
        for j, y in enumerate(b, 1):
            row, col = last_row.get(y, 0), last_col
            if x == y:
                last_col = j
            d[i + 1][j + 1] = min(
                d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][col] + (i - row - 1) + 1 + (j - col - 1)
            )
        last_row[x] = i
    return d[-1][-1]


def chunk_sets(max_edits: int, agree: int) -> list[tuple[int, ...]]:
    """Sets of ``agree`` chunks, one of which stays whole whatever ``max_edits`` edits do to 2 * max_edits + agree chunks.

    An edit touches one chunk, or two neighbours where it exchanges characters
    across their border: hence twice the edits. Sets are taken greedily.
    """
    chunks = 2 * max_edits + agree
    borders = [{i, i + 1} for i in range(chunks - 1)] or [set()]
    open_hits = {frozenset().union(*hit) for hit in combinations_with_replacement(borders, max_edits)}
    sets = list(combinations(range(chunks), agree))
    found = []
    while open_hits:
        best = max(sets, key=lambda s: sum(h.isdisjoint(s) for h in open_hits))
        found.append(best)
        open_hits = {h for h in open_hits if not h.isdisjoint(best)}
    return sorted(found)


def shifts(max_edits: int, agree: int) -> list[tuple[int, ...]]:
    """(how far each chunk of a set has moved, how much longer the name has become), by at most ``max_edits`` insertions and deletions."""
    moves = range(-max_edits, max_edits + 1)
    return [m for m in product(moves, repeat=agree + 1) if abs(m[0]) + sum(abs(b - a) for a, b in zip(m, m[1:], strict=False)) <= max_edits]


def _part(name: Column, begin: Column, size: Column) -> Column:
    """``size`` characters from ``begin``, counted from 0."""
    return name.substr(begin + 1, size)


def _keys(names: DataFrame, max_edits: int, agree: int, least_chunk: int, probing: bool) -> DataFrame:
    """(key, name): for indexed names a key for each set of chunks, for probing names one for each place where those may now stand."""
    chunks = 2 * max_edits + agree
    ways = shifts(max_edits, agree) if probing else [(0,) * (agree + 1)]
    rows = [(s, *of, *way) for s, of in enumerate(chunk_sets(max_edits, agree)) for way in ways]
    fields = ["s", *[f"i{k}" for k in range(agree)], *[f"d{k}" for k in range(agree)], "more"]
    way = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row, strict=True)]) for row in rows]))
    at = names.select("name", way.alias("w")).select("name", "w.*").withColumn("size", F.char_length("name") - F.col("more"))
    at = at.withColumn("q", F.floor(F.col("size") / chunks).cast("int")).where(F.col("q") >= least_chunk)
    begins = [F.col(f"i{k}") * F.col("q") + F.col(f"d{k}") for k in range(agree)]
    inside = F.lit(True)
    for b in begins:
        inside = inside & (b >= 0) & (b + F.col("q") <= F.char_length("name"))
    return at.where(inside).select(F.xxhash64("size", "s", *[_part(F.col("name"), b, F.col("q")) for b in begins]).alias("key"), "name")


def _shortened(names: DataFrame, times: int) -> DataFrame:
    """(key, name): the hash of every text that is left of a name after ``times`` deletions or fewer."""
    level = out = names.select("name", F.col("name").alias("left"))
    for _ in range(times):
        level = level.where(F.char_length("left") > 0).select("name", "left", F.explode(F.sequence(F.lit(1), F.char_length("left"))).alias("i"))
        level = level.select("name", F.concat(F.col("left").substr(F.lit(1), F.col("i") - 1), F.col("left").substr(F.col("i") + 1, F.char_length("left"))).alias("left")).distinct()
        out = out.unionByName(level)
    return out.select(F.xxhash64("left").alias("key"), "name")


def near_names(indexed: DataFrame, probing: DataFrame, max_edits: int = 1, agree: int = AGREE, least_chunk: int = LEAST_CHUNK) -> DataFrame:
    """All pairs of a name of ``indexed`` and one of ``probing`` (columns ``name``) at most ``max_edits`` apart.

    An indexed name is cut into 2 * max_edits + agree disjoint chunks of equal
    size. Each edit spoils two of them at most, so ``agree`` chunks are still
    whole in the other name, moved by no more than the insertions and deletions
    before them. Sets of ``agree`` chunks are the index keys, with their set and
    the length; the other side probes its q-grams at all places and lengths that
    fit. Names too short for chunks of ``least_chunk`` characters are handled
    exhaustively: by all texts that are left of both after up to ``max_edits``
    deletions. Pairs that meet are held against a bound of 2 * max_edits on
    the plain edit distance, then against the exact distance in Arrow batches.
    Both ways find every pair; keys are hashes, so chance meetings are only
    compared. Sides are shuffled on the keys in sort-merge joins, which adaptive
    execution can split; nothing is broadcast or collected.

    Returns (indexed_name, probing_name, distance), each pair once.

    Edge cases: null and empty names take no part; repeated names count once;
    names of one character and very long ones are like any other (time grows
    with the square of a name only where it meets another); empty tables give an
    empty table; other columns are not looked at.
    """
    spark = indexed.sparkSession
    bounded_batches(spark)
    a, b = (df.select("name").where(F.char_length("name") > 0).distinct() for df in (indexed, probing))
    short = least_chunk * (2 * max_edits + agree)
    size = F.char_length("name")
    ways = [
        (_keys(a, max_edits, agree, least_chunk, False), _keys(b, max_edits, agree, least_chunk, True)),
        (_shortened(a.where(size < short), max_edits), _shortened(b.where(size < short + max_edits), max_edits)),
    ]
    met = [
        x.withColumnRenamed("name", "indexed_name").hint("merge").join(y.withColumnRenamed("name", "probing_name"), "key").where(F.levenshtein("indexed_name", "probing_name", 2 * max_edits) >= 0)
        for x, y in ways
    ]
    pairs = met[0].unionByName(met[1]).select("indexed_name", "probing_name").distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [damerau_levenshtein(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["indexed_name", "probing_name", "distance"])

    return pairs.mapInArrow(measure, "indexed_name string, probing_name string, distance int").where(F.col("distance") <= max_edits)


def misspelt(id_col: str, name_col: str) -> Column:
    """A name with two neighbouring characters exchanged, as its id decides; where the id's checksum is odd, the name as it is."""
    h, size, name = F.crc32(F.col(id_col).cast("string")), F.char_length(name_col), F.col(name_col)
    i = F.pmod(h, F.greatest(size - 1, F.lit(1)).cast("long")).cast("int")
    swapped = F.concat(_part(name, F.lit(0), i), _part(name, i + 1, F.lit(1)), _part(name, i, F.lit(1)), _part(name, i + 2, size))
    return F.when((h % 2 == 0) & (size >= 2), swapped).otherwise(name)


def join_by_name(clients: DataFrame, vendors: DataFrame, max_edits: int = 1, client_id: str = "client_id", vendor_id: str = "vendor_id", name: str = "name") -> DataFrame:
    """For each vendor and distance, the clients whose names are that close to the vendor's.

    Clients fall together by name before they meet anything, so a name that a
    third of them bears is one row; names are joined by ``near_names``, and the
    counts by name are added up for each vendor's name, then handed to the vendors.

    Returns (vendor_id, distance, n_clients, first_client_id, clients_crc):
    the number of clients, their smallest id, and the sum of the checksums of
    their ids. Pairs over ``max_edits`` apart are not there.

    Edge cases: null and empty names take no part; rows that repeat id and name
    count once; a null client id counts as a client without a checksum; vendors
    with a null id form one group; a vendor id with several names adds up what
    each of them finds; empty tables give an empty table; other columns are not
    looked at.
    """
    def named(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(name).alias("name")).where(F.char_length("name") > 0).distinct()

    theirs = cut(
        named(clients, client_id)
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.sum(F.crc32(F.col("id").cast("string"))).alias("crc"))
    )
    ours = cut(named(vendors, vendor_id))
    pairs = near_names(ours, theirs, max_edits)
    found = (
        pairs.hint("merge").join(theirs, F.col("probing_name") == F.col("name"))
        .groupBy(F.col("indexed_name"), "distance")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
        .select(F.struct(F.col("indexed_name").alias("name")).alias("k"), "distance", "n", "first", "crc")
    )
    held = ours.select(F.struct("name").alias("k"), "id").hint("merge").join(found, "k")
    return held.groupBy(F.col("id").alias("vendor_id"), "distance").agg(
        F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.coalesce(F.sum("crc"), F.lit(0)).cast("long").alias("clients_crc")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients and vendors at distance 0 and 1, the vendors' names misspelt first."""
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", misspelt("vendor_id", "name").alias("name"))
    return join_by_name(table(spark, sf_dir, "clients"), vendors)


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT FOR x IN string_split({id}::VARCHAR, '')]),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

ORACLE_SQL = f"""
WITH h AS (SELECT DISTINCT vendor_id, name, {_CRC.format(id="vendor_id")} AS h FROM vendors WHERE length(name) > 0),
v AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND length(name) >= 2
        THEN substr(name, 1, (h % (length(name) - 1))::INT) || substr(name, (h % (length(name) - 1))::INT + 2, 1)
          || substr(name, (h % (length(name) - 1))::INT + 1, 1) || substr(name, (h % (length(name) - 1))::INT + 3)
        ELSE name END AS name FROM h),
c AS (SELECT DISTINCT client_id, name, {_CRC.format(id="client_id")} AS crc FROM clients WHERE length(name) > 0),
vn AS (SELECT DISTINCT name FROM v), cn AS (SELECT DISTINCT name FROM c),
vi AS (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM vn), ci AS (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM cn),
vd AS (SELECT name, i, substr(name, 1, i - 1) || substr(name, i + 1) AS d FROM vi),
cd AS (SELECT name, i, substr(name, 1, i - 1) || substr(name, i + 1) AS d FROM ci),
vs AS (SELECT name, substr(name, 1, i - 1) || substr(name, i + 1, 1) || substr(name, i, 1) || substr(name, i + 2) AS d FROM vi WHERE i < length(name)),
one AS (SELECT vd.name AS a, cn.name AS b FROM vd JOIN cn ON vd.d = cn.name
  UNION SELECT vn.name, cd.name FROM cd JOIN vn ON cd.d = vn.name
  UNION SELECT vd.name, cd.name FROM vd JOIN cd ON vd.i = cd.i AND vd.d = cd.d
  UNION SELECT vs.name, cn.name FROM vs JOIN cn ON vs.d = cn.name),
p AS (SELECT a, b, 1 AS distance FROM one WHERE a <> b UNION ALL SELECT vn.name, cn.name, 0 FROM vn JOIN cn ON vn.name = cn.name)
SELECT v.vendor_id, p.distance, count(*) AS n_clients, min(c.client_id) AS first_client_id, coalesce(sum(c.crc), 0)::BIGINT AS clients_crc
FROM v JOIN p ON v.name = p.a JOIN c ON c.name = p.b GROUP BY 1, 2
"""
