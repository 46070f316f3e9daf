"""Random splits and folds of exact size that depend on the rows alone.

Rows are put in the order of a seeded 60-bit hash of their id or content, and a part is a range of
that order.  The range ends are found from counts per hash prefix, so assigning parts is a
comparison with literals: no sort, no shuffle, and the same answer on every re-run.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorage.settle import settle

SEED = 42
_COPIES_PER_TASK = 1_000_000
#: Rows with one hash prefix, which are put in order in one task where a part ends in them, and bounds of the prefix's bits.
_PREFIX_ROWS, _LEAST_BITS, _MOST_BITS = 100_000, 6, 22
#: Values a stratum may have: the counts per prefix of each are collected.
_MOST_STRATA = 200

#: Row count per stratum -> sizes of the parts per stratum.
Sizes = Callable[[dict], dict]


_HASH_BITS = 60


def row_hash(columns: Sequence[str], seed: int = SEED) -> Column:
    """60 bits of the md5 of the seed and the columns' texts, by name order, with 0x1F between them."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(columns)]
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def with_parts(
    df: DataFrame,
    sizes: Sizes,
    *,
    stratum: str | None = None,
    by: Sequence[str] | None = None,
    seed: int = SEED,
    to: str = "part",
    stored: bool = False,
) -> DataFrame:
    """Add the part number of every row; part ``i`` of a stratum has exactly the size asked for.

    ``by`` names the columns whose hash orders the rows: a row's id, so that the last digit of some average
    does not move it to another part. Without it all columns count.

    ``stratum`` is a column of few values, such as a class label; more than some hundred are refused.  Range ends found in one pass must
    hold in the next, so the rows are settled first, unless they already are (``stored``).
    """
    if not stored:
        df = settle(df)
    key = F.col(stratum) if stratum else F.lit(0)
    keyed = df.withColumns({"_stratum": key, "_hash": row_hash(by or df.columns, seed)})
    facts = keyed.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("_stratum").alias("strata")).first()
    if facts["strata"] > _MOST_STRATA:
        raise ValueError(f"a stratum of about {facts['strata']} values: at most {_MOST_STRATA} are dealt")
    bits = min(_MOST_BITS, max(_LEAST_BITS, (facts["rows"] // _PREFIX_ROWS).bit_length()))
    prefix = F.shiftright("_hash", _HASH_BITS - bits)
    prefixes = defaultdict(dict)
    for r in keyed.groupBy("_stratum", prefix.alias("p")).count().collect():
        prefixes[r["_stratum"]][r["p"]] = r["count"]
    totals = {s: sum(counts.values()) for s, counts in prefixes.items()}

    totals = totals or {0: 0}
    # Last position (1-based) of every part but the final one -> the prefix it falls into.
    ends, parts = [], sizes(totals)
    for s, counts in prefixes.items():
        if sum(parts[s]) != totals[s]:
            raise ValueError(f"part sizes {parts[s]} do not add up to {totals[s]} rows")
        reached = [sum(parts[s][: i + 1]) for i in range(len(parts[s]) - 1)]
        seen = 0
        for p in sorted(counts):
            ends += [(s, p, seen, end) for end in reached if seen < end <= seen + counts[p]]
            seen += counts[p]
        ends += [(s, None, 0, 0) for end in reached if end == 0]
    cuts = _cuts(keyed, prefix, ends)

    part = F.lit(0)
    shared = defaultdict(list)
    for s, hash_value, before, count, end in cuts:
        of_stratum = F.col("_stratum").eqNullSafe(F.lit(s))
        if hash_value is None:
            part = part + of_stratum.cast("int")
            continue
        part = part + (of_stratum & (F.col("_hash") > F.lit(hash_value))).cast("int")
        if end < before + count:
            shared[(s, hash_value, before)].append(end)
    clean_cut = keyed.withColumn(to, part)
    if not shared:
        return clean_cut.drop("_stratum", "_hash")
    split = F.lit(False)
    for s, hash_value, _ in shared:
        split = split | (F.col("_stratum").eqNullSafe(F.lit(s)) & (F.col("_hash") == F.lit(hash_value)))
    whole = clean_cut.where(~split).drop("_stratum", "_hash")
    return whole.unionByName(_dealt_copies(clean_cut.where(split), shared, to, df.columns))


def _cuts(keyed: DataFrame, prefix: Column, ends: list) -> list:
    """(stratum, hash, rows before it, rows with it, end) for every part end."""
    none = [(s, None, 0, 0, 0) for s, p, _, _ in ends if p is None]
    ends = [e for e in ends if e[1] is not None]
    if not ends:
        return none
    spark = keyed.sparkSession
    stratum_type = keyed.schema["_stratum"].dataType
    cells = spark.createDataFrame(
        [(s, p, base, end) for s, p, base, end in ends],
        T.StructType(
            [
                T.StructField("_stratum", stratum_type),
                T.StructField("p", T.LongType()),
                T.StructField("base", T.LongType()),
                T.StructField("end", T.LongType()),
            ]
        ),
    )
    chosen = F.lit(False)
    for s, p in {(s, p) for s, p, _, _ in ends}:
        chosen = chosen | (F.col("_stratum").eqNullSafe(F.lit(s)) & (prefix == F.lit(p)))
    hashes = keyed.where(chosen).groupBy("_stratum", prefix.alias("p"), "_hash").count()
    run = Window.partitionBy("_stratum", "p").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = hashes.withColumn("upto", F.sum("count").over(run))
    same = placed["_stratum"].eqNullSafe(cells["_stratum"]) & (placed["p"] == cells["p"])
    hits = placed.join(F.broadcast(cells), same).where(  # one cell per part end
        (F.col("end") > F.col("base") + F.col("upto") - F.col("count"))
        & (F.col("end") <= F.col("base") + F.col("upto"))
    )
    found = hits.select(
        placed["_stratum"],
        "_hash",
        (F.col("base") + F.col("upto") - F.col("count")).alias("before"),
        "count",
        "end",
    ).collect()
    return none + [(r["_stratum"], r["_hash"], r["before"], r["count"], r["end"]) for r in found]


def _dealt_copies(rows: DataFrame, shared: dict, to: str, columns: list[str]) -> DataFrame:
    """Rows whose hash straddles a part end: equal copies, dealt out by counting them.

    Copies are folded to (row, count) and unfolded again chunk by chunk, so however many there
    are, no task holds them all.
    """
    run = Window.partitionBy("_stratum", "_hash").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.groupBy("_stratum", "_hash", *columns, to).agg(F.count(F.lit(1)).alias("_count"))
    placed = counted.withColumn("_from", F.sum("_count").over(run) - F.col("_count"))
    chunk = F.lit(_COPIES_PER_TASK)
    chunks = (
        placed.withColumn(
            "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / chunk).cast("int")))
        )
        .repartition("_hash", "_chunk")
        .withColumn("_first", F.col("_chunk") * chunk)
        .withColumn("_last", F.least(F.col("_count"), F.col("_first") + chunk) - 1)
    )
    copies = chunks.withColumn("_copy", F.explode(F.sequence("_first", "_last"))).withColumn(
        "_at", F.col("_from") + F.col("_copy")
    )
    beyond = F.lit(0)
    for (s, hash_value, before), ends in shared.items():
        here = F.col("_stratum").eqNullSafe(F.lit(s)) & (F.col("_hash") == F.lit(hash_value))
        for end in ends:
            beyond = beyond + (here & (F.col("_at") >= F.lit(end - before))).cast("int")
    return copies.withColumn(to, F.col(to) + beyond).select(*columns, to)


def exact_split(
    df: DataFrame, test_size: float, *, by: Sequence[str] | None = None, seed: int = SEED, stored: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ceil(rows * test_size) test rows."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")

    def sizes(totals: dict) -> dict:
        rows = totals.get(0, 0)
        test = math.ceil(rows * test_size)
        if test == 0 or test == rows:
            raise ValueError(f"{rows} rows cannot be split into a training and a test set")
        return {0: [test, rows - test]}

    parts = with_parts(df, sizes, by=by, seed=seed, to="_part", stored=stored)
    return parts.where("_part = 1").drop("_part"), parts.where("_part = 0").drop("_part")


def fold_sizes(totals: dict, folds: int) -> dict:
    """Fold sizes per stratum: strata laid end to end are dealt to the folds in turn.

    So both the folds and the shares of a stratum differ by one row at most.
    """
    sizes, start = {}, 0
    for s in sorted(totals, key=lambda v: (v is None, v)):
        stop = start + totals[s]
        sizes[s] = [len(range(start + (i - start) % folds, stop, folds)) for i in range(folds)]
        start = stop
    return sizes


def with_folds(
    df: DataFrame,
    folds: int,
    *,
    label: str | None = None,
    by: Sequence[str] | None = None,
    seed: int = SEED,
    to: str = "fold",
    stored: bool = False,
) -> DataFrame:
    """Add a fold number 0..folds-1; with ``label`` every fold gets its share of each class."""

    def sizes(totals: dict) -> dict:
        if folds < 2 or sum(totals.values()) < folds:
            raise ValueError(f"{sum(totals.values())} rows cannot be put into {folds} folds")
        return fold_sizes(totals, folds)

    return with_parts(df, sizes, stratum=label, by=by, seed=seed, to=to, stored=stored)
