"""Stable shards by jump consistent hashing, without a ring table.

``jump_hash`` follows Lamping and Veach: a 64-bit linear congruential stream seeded by the key decides how
often the key would have moved while buckets were appended one by one; the last bucket it moved into is its shard.
With one more shard a key stays or goes to the new shard. Everything is column arithmetic; the 64-bit product is made of
16-bit limbs because checked integers may not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Multiplier of the published generator, as 16-bit limbs from the lowest; its numerator is 2**31.
MULTIPLIER = 2862933555777941757
LIMBS = [MULTIPLIER >> 16 * i & 0xFFFF for i in range(4)]
NUMERATOR = 2147483648.0
MASK = 0xFFFFFFFF
USUAL_STEPS = 48


def _step(state: Column, shards: int) -> Column:
    """One draw: ``b`` takes the bucket, ``j`` the next one the key would jump to."""
    high, low = state["hi"], state["lo"]
    mid = low * F.lit(LIMBS[1])
    top = low * F.lit(LIMBS[3])
    base = low * F.lit(LIMBS[0]) + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carried = (F.shiftright(base, 32) + F.shiftright(mid, 16) + low * F.lit(LIMBS[2])
               + F.shiftleft(top.bitwiseAND(F.lit(0xFFFF)), 16) + high * F.lit(LIMBS[0])
               + F.shiftleft((high * F.lit(LIMBS[1])).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))
    jump = ((state["j"] + 1).cast("double") * (F.lit(NUMERATOR) / (F.shiftright(carried, 1) + 1).cast("double"))).cast("long")
    moved = F.struct(carried.alias("hi"), base.bitwiseAND(F.lit(MASK)).alias("lo"), state["j"].alias("b"), jump.alias("j"))
    return F.when(state["j"] >= F.lit(shards).cast("long"), state).otherwise(moved)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. ``shards`` - 1 of a long key; null keys count as key 0.

    The number of draws is about ln(shards). The usual ones are walked at once; the remaining steps, up to the
    certain bound of ``shards``, only run for a key that needs them.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"),
                     F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    walk = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: _step(s, shards))
    if shards <= USUAL_STEPS:
        return walk(start, shards)["b"].cast("int")
    usual = walk(start, USUAL_STEPS)
    return F.when(usual["j"] >= shards, usual["b"]).otherwise(walk(usual, shards)["b"]).cast("int")


def assign(rows: DataFrame, key: str = "doc_id", shards: int = 16, shard: str = "shard", grown: str | None = "grown_shard",
           ) -> DataFrame:
    """Adds the shard of every row and, unless ``grown`` is None, its shard when one is appended.

    Narrow: no row moves. Nulls count as key 0; text keys are hashed to 64 bits first; repeated keys share a
    shard; an empty table gives an empty table. Existing columns with the new names are replaced.
    """
    column = F.col(key)
    if dict(rows.dtypes)[key] in ("string", "binary"):
        column = F.xxhash64(column)
    rows = rows.withColumn(shard, jump_hash(column, shards))
    return rows if grown is None else rows.withColumn(grown, jump_hash(column, shards + 1))


def numbered(rows: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard gaplessly from 0, ordered by ``order`` (nulls first).

    A shard may be larger than a task, so nothing is ordered per shard: equal rows are counted first (map-side), the rows
    are dealt by ranges of (shard, order, copy) that also split equal rows, and only the row
    counts of the ranges are summed up. All columns of ``rows`` are returned.
    """
    names = rows.columns
    copies = rows.groupBy(*names).agg(F.count("*").alias("__n"))
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")
    keys = [shard, *order, *(n for n in names if n != shard and n not in order), "__copy"]
    placed = copies.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("__range", F.shiftright("__place", 33)), "slots")
    ranges = placed.groupBy(shard, "__range").agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(shard).alias("__shard"), F.col("__range").alias("__in"), "__first",
                           F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    joined = placed.join(ranges, (F.col(shard) == F.col("__shard")) & (F.col("__range") == F.col("__in")))
    return joined.select(*names, (F.col("__offset") + F.col("__place") - F.col("__first")).alias(slot))


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of all documents.

    A null text has size 1 and the checksum of no bytes. Rows with a null id share the shard of key 0; equal rows
    take neighbouring slots.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(rows, "doc_id", shards)
    slots = numbered(rows, "shard", ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sql(shards: int = 16) -> str:
    """The same for DuckDB: 128-bit arithmetic for the stream, a bytewise fold for the checksum."""
    product = "(k * " + str(MULTIPLIER) + " + 1) % 18446744073709551616"
    step = f"cast(floor((j + 1)::double * (2147483648.0::double / ((({product}) // 8589934592) + 1)::double)) as bigint)"
    walks = ", ".join(
        f"w{n}(doc, k, b, j) as (select doc, k, 0::bigint, 0::bigint from ids union all "
        f"select doc, {product}, j, {step} from w{n} where j < {n})" for n in (shards, shards + 1))
    last = lambda n: f"s{n} as (select doc, max(b) as b from w{n} group by doc)"
    crc = ("case when strlen(t) = 0 then 0 else xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform("
           "regexp_extract_all(hex(encode(t)), '..'), lambda x: cast('0x' || x as bigint))), "
           "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) end")
    bits = "list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    return f"""
with recursive ids as (select distinct coalesce(doc_id, 0) as doc,
  case when coalesce(doc_id, 0) < 0 then coalesce(doc_id, 0)::hugeint + 18446744073709551616 else coalesce(doc_id, 0)::hugeint end as k
  from documents), {walks}, {last(shards)}, {last(shards + 1)},
codes as (select list_transform(range(256), lambda n: {bits}) as tab),
docs as (select doc_id, coalesce(text, '') as t from documents),
sized as (select doc_id, strlen(t)::bigint + 1 as size, cast({crc} as bigint) as text_crc32 from docs, codes)
select doc_id, size, text_crc32, 'key' as law, s{shards}.b::int as shard,
  row_number() over (partition by s{shards}.b order by doc_id nulls first, size, text_crc32) - 1 as slot, s{shards + 1}.b::int as grown_shard
from sized join s{shards} on s{shards}.doc = coalesce(doc_id, 0) join s{shards + 1} on s{shards + 1}.doc = coalesce(doc_id, 0)"""
