"""Sharding by a hierarchical weighted hash tree.

Shards hang in racks and racks in regions. Every shard draws ``-ln(u) / weight`` from a hash of the document's id
and the shard's name, and a subtree's draw is the least one below it: that is a weighted draw too, whose weight is the sum
of the subtree's (the least of exponential draws has the sum of their rates). The document descends from level to level into
the child with the smallest draw.

A subtree's draw changes only if a weight in it does. A greater weight or a new shard can only make a subtree's draws smaller,
so documents move only into it, and within it only towards what has changed: one more shard, wherever it hangs,
takes documents only into itself, for any number of shards. A smaller weight only moves documents out of its subtree.

A document's cost is one draw per shard; draws are made once for the tree and the tree with one shard more.

Nulls and edge cases: a null text has size 1 and the checksum of the empty text; a null id is an id of its own (that of
the text ``null``); repeated rows go to the same shard and have slots of their own; an empty table gives an empty result;
clashing column names of the input are replaced by the names that the operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import UNIT_DRAW_SQL, cut, numbered, unit_draw

SEED = "tree-2"
Tree = dict[str, dict[str, list[int]]]


def tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards 0, 1, ... dealt to racks and regions in order; each full region is followed by another."""
    out: Tree = {}
    for s in range(shards):
        out.setdefault(f"g{s // (per_rack * racks)}", {}).setdefault(f"r{s // per_rack}", []).append(s)
    return out


def draws(key: Column, shards: list[int], weights: dict[int, float] | None = None, seed: str = SEED) -> Column:
    """An array with each shard's draw for a key."""
    named = F.array(*[F.struct(F.lit(f"s{s}").alias("name"), F.lit(float((weights or {}).get(s, 1))).alias("weight")) for s in shards])
    return F.transform(named, lambda x: -F.log(unit_draw(F.lit(seed), x["name"], key)) / x["weight"])


def walk(drawn: Column, nodes: Tree, places: dict[int, int]) -> Column:
    """The shard at the end of the descent, given the array of draws and where in it each shard's draw is."""

    def least(shards: list[int]) -> Column:
        return F.array_min(F.array(*[drawn[places[s]] for s in shards]))

    def choose(children: list[tuple[list[int], Column]]) -> Column:
        if len(children) == 1:
            return children[0][1]
        found = F.array(*[F.struct(least(shards).alias("draw"), F.lit(k).alias("child")) for k, (shards, _) in enumerate(children, 1)])
        return F.element_at(F.array(*[below for _, below in children]), F.array_min(found)["child"])

    return choose([
        ([s for shards in racks.values() for s in shards], choose([(shards, choose([([s], F.lit(s)) for s in shards])) for shards in racks.values()]))
        for racks in nodes.values()
    ])


def descend(key: Column, nodes: Tree, weights: dict[int, float] | None = None, seed: str = SEED) -> Column:
    return routes(key, [nodes], weights, seed)[0]


def routes(key: Column, trees: list[Tree], weights: dict[int, float] | None = None, seed: str = SEED) -> Column:
    """An array with the key's shard in each of several trees, whose draws are made once."""
    shards = sorted({s for nodes in trees for racks in nodes.values() for below in racks.values() for s in below})
    places = {s: k for k, s in enumerate(shards)}
    return F.transform(F.array(draws(key, shards, weights, seed)), lambda drawn: F.array(*[walk(drawn, nodes, places) for nodes in trees]))[0]


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", weights: dict[int, float] | None = None) -> DataFrame:
    """Each row's size, checksum, shard, its shard in a tree with one more, and its slot: its place in the shard in the order of key, size and checksum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    sized = docs.select(
        key, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        routes(name, [tree(shards), tree(shards + 1)], weights).alias("route"),
    )
    sized = cut(sized.select(key, "size", "text_crc32", F.col("route")[0].alias("shard"), F.col("route")[1].alias("grown_shard")), "shards")
    out = numbered(sized, "shard-slots", [F.col(key).asc_nulls_first(), F.col("size"), F.col("text_crc32")], ["shard"])
    return out.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("place").cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# A checksum is the CRC-32 of zlib, byte by byte; the shard with the least draw is where the descent ends.
OP9_SQL = f"""
WITH RECURSIVE steps(k, v, i) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM steps WHERE i = 8),
d AS (
  SELECT row_number() OVER () AS n, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
drawn AS (
  SELECT n, s, -ln({UNIT_DRAW_SQL.format(f"'{SEED}/s' || s || '/' || coalesce(doc_id::VARCHAR, 'null')")}) AS draw FROM d, range(9) r(s)),
route AS (SELECT n, arg_min(s, draw) FILTER (s < 8) AS shard, arg_min(s, draw) AS grown_shard FROM drawn GROUP BY n),
sized AS (
  SELECT doc_id, size::BIGINT AS size, shard::INT AS shard, grown_shard::INT AS grown_shard,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)::BIGINT AS text_crc32
  FROM d JOIN route USING (n), crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM sized
"""
