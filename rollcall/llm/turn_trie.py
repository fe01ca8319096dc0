"""The trie of conversations' turns, by prefix doubling.

Each distinct turn (role and text) gets a number, its name. In each further round two neighbouring
blocks become one of twice the length, and each distinct pair of names gets a name: after as many
rounds as the longest conversation's length has bits, all blocks of 1, 2, 4, ... turns that begin
at a multiple of their length have names, and equal blocks have equal ones. A prefix of d turns is one block for
each bit of d, so the names of these blocks, in order, say which prefix it is. Conversations with
the same are grouped to a node. All of this is joins and groupings of slim rows; no conversation is gathered in one row.

A node is known by its depth and by the smallest conversation in it. That conversation is the smallest of all deeper
nodes on its way too, so what a node adds up over its subtree is the sum, over its members, of what each
member adds from that depth on where it is the smallest.

Defined cases: rows without a conv_id belong to no conversation and are left out. A null role or text is
empty. Turns stand in the order of turn, role and text, null first; repeated rows are turns of their
own. Of an empty table the result is empty, without a root. Columns other than conv_id, turn, role and text
don't matter, whatever their names. Turns are told apart by the SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import discard, lean, numbered, written

#: Turns of a conversation that one window sums; longer ones are summed stretch by stretch.
STRETCH = 1 << 10
#: The rebuilding of the query: conversations share the first turns of every hundredth one.
HEAD_EVERY, HEAD_MOST = 100, 6


def named_turns(rows: DataFrame, paths: list[str]) -> DataFrame:
    """conv_id, pos (from 0), len (the conversation's turns), name and chars (code points of the text)."""
    passed: list[str] = []
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    what = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    turns = turns.withColumns({"what": what, "chars": F.length("text").cast("long")})
    turns = numbered(turns, "turns", "conv_id", "turn", "role", "text", keep=["conv_id", "what", "chars"], paths=passed)
    convs = turns.groupBy("conv_id").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("len"))
    names = numbered(turns.select("what").distinct(), "turn-names", paths=passed).withColumnRenamed("nth", "name")
    out = turns.join(convs, "conv_id").join(names, "what").select("conv_id", (F.col("nth") - F.col("first")).alias("pos"), "len", "name", "chars")
    out = written(out, "named-turns", paths)
    discard(rows.sparkSession, passed)
    return out


def _blocks(turns: DataFrame, longest: int, paths: list[str]) -> list[DataFrame]:
    """conv_id, len, k and name of the k-th block of 1, 2, 4, ... turns."""
    blocks = [turns.select("conv_id", "len", F.col("pos").alias("k"), "name")]
    while 2 << (len(blocks) - 1) <= longest:
        side = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("conv_id", "len", F.expr("k div 2").alias("k")).agg(side(0).alias("a"), side(1).alias("b")).where("b IS NOT NULL")
        names = numbered(pairs.select("a", "b").distinct(), "pair-names", paths=paths).withColumnRenamed("nth", "name")
        blocks.append(written(pairs.join(names, ["a", "b"]).select("conv_id", "len", "k", "name"), "blocks", paths))
    return blocks


def _prefixes(turns: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """conv_id, len, depth, chars (of the last turn) and key (the names of the blocks) of all prefixes but the empty one."""
    none = F.lit(None).cast("struct<bit:int,name:bigint>").alias("block")
    rows = turns.select("conv_id", "len", (F.col("pos") + 1).alias("depth"), "chars", none)
    for bit, own in enumerate(blocks):
        # a block whose number is even ends the higher bits of the depths up to where the next but one begins
        reach = F.sequence((F.col("k") + 1) * (1 << bit), F.least("len", (F.col("k") + 2) * (1 << bit) - 1))
        block = F.struct(F.lit(bit).alias("bit"), F.col("name").alias("name"))
        rows = rows.unionAll(own.where("k % 2 = 0").select("conv_id", "len", F.explode(reach), F.lit(0).cast("long"), block))
    key = F.transform(F.sort_array(F.collect_list("block"), asc=False), lambda b: b["name"])
    return rows.groupBy("conv_id", "len", "depth").agg(F.max("chars").alias("chars"), key.alias("key"))


def _from_here_on(rows: DataFrame, **sums: Column) -> DataFrame:
    """The rows with sums over the same conversation's rows of this depth or more."""
    rows = rows.withColumn("__s", F.expr(f"depth div {STRETCH}")).withColumns({f"__{x}": c for x, c in sums.items()})
    later = Window.partitionBy("conv_id").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("conv_id", "__s").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    past = rows.groupBy("conv_id", "__s").agg(*[F.sum(f"__{x}").alias(f"__all_{x}") for x in sums])
    past = past.select("conv_id", "__s", *[F.coalesce(F.sum(f"__all_{x}").over(later), F.lit(0)).alias(f"__past_{x}") for x in sums])
    rows = rows.select("*", *[F.sum(f"__{x}").over(here).alias(f"__here_{x}") for x in sums]).join(past, ["conv_id", "__s"])
    return rows.withColumns({x: F.col(f"__here_{x}") + F.col(f"__past_{x}") for x in sums})


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the conversations that end at each.

    turns: conv_id, pos, len, name, chars, as ``named_turns`` gives them; convs: conv_id and len of all conversations, those
    without turns too. Nodes: conv_id (the smallest), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens. Ends: depth and conv_id of the node, member.
    """
    spark, passed = turns.sparkSession, []
    longest, least, many = convs.agg(F.coalesce(F.max("len"), F.lit(0)), F.min("conv_id"), F.count(F.lit(1))).first()
    prefixes = written(_prefixes(turns, _blocks(turns, longest, passed)), "prefixes", passed)
    groups = prefixes.groupBy("depth", "key").agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("n"), F.max((F.col("len") > F.col("depth")).cast("int")).alias("goes_on"))
    placed = prefixes.join(groups, ["depth", "key"]).select("conv_id", "len", "depth", "chars", "top", "n", "goes_on")
    # all conversations meet in the root, which three numbers describe
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", "len", zero.alias("depth"), zero.alias("chars"), F.lit(least).cast("long").alias("top"), F.lit(many).cast("long").alias("n"), F.lit(int(longest > 0)).alias("goes_on"))
    placed = written(placed.unionAll(root), "placed")
    discard(spark, passed)
    first = F.col("top") == F.col("conv_id")
    sums = _from_here_on(placed, saved=F.when(first, (F.col("n") - 1) * F.col("chars")).otherwise(0), leaves=(first & (F.col("goes_on") == 0)).cast("long"))
    nodes = sums.groupBy("depth", "top").agg(F.count(F.lit(1)).alias("n_convs"), F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    above = placed.select(F.col("conv_id").alias("top"), (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent_conv_id"))
    nodes = written(nodes.join(above, ["top", "depth"], "left"), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("top")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "top"], "left")
    long = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    nodes = nodes.select(F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", *[long(x) for x in ("n_children", "n_leaves", "saved_tokens")])
    return nodes, placed.where("len = depth").select("depth", F.col("top").alias("conv_id"), F.col("conv_id").alias("member"))


def digests(ends: DataFrame) -> DataFrame:
    """depth, conv_id and ends_sha256: the digest of a node's members, in order, with commas between. Members pass by and aren't gathered."""

    def run(batches):
        open_, digest = None, None
        done: list[tuple[int, int, str]] = []

        def given():
            out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "conv_id", "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            depth, top, member = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((depth[1:] != depth[:-1]) | (top[1:] != top[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(depth)]):
                if a == b:
                    continue
                node, text = (int(depth[a]), int(top[a])), ",".join(map(str, member[a:b].tolist()))
                if node == open_:
                    digest.update(b"," + text.encode())
                else:
                    if open_ is not None:
                        done.append((*open_, digest.hexdigest()))
                    open_, digest = node, hashlib.sha256(text.encode())
            yield given()
        if open_ is not None:
            done.append((*open_, digest.hexdigest()))
        yield given()

    dealt = ends.select("depth", "conv_id", "member").repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "member")
    return dealt.mapInArrow(lean(run), "depth long, conv_id long, ends_sha256 string")


def rebuilt(turns: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations, each conversation with its first turns replaced by those of the hundredth one before it."""
    own = turns.groupBy("conv_id").agg(F.first("len").alias("len"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_MOST
    own = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % HEAD_EVERY})
    lens = own.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    convs = own.join(lens, "base", "left").withColumn("head", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("len") - F.col("h"))).alias("len")), "rebuilt", paths)
    heads = turns.where(F.col("pos") < HEAD_MOST).select(F.col("conv_id").alias("base"), "pos", "name", "chars")
    heads = heads.join(convs, "base").where("pos < h").select("conv_id", "pos", "len", "name", "chars")
    tails = turns.drop("len").join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "len", "name", "chars")
    return written(heads.unionAll(tails), "rebuilt-turns", paths), convs.select("conv_id", "len")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return rebuilt_nodes(rows)


def rebuilt_nodes(rows: DataFrame) -> DataFrame:
    paths: list[str] = []
    turns, convs = rebuilt(named_turns(rows, paths), paths)
    nodes, ends = prefix_trie(turns, convs)
    discard(rows.sparkSession, paths)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(digests(ends), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), b AS (
  SELECT c, c - c % {HEAD_EVERY} AS base, list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)) AS bytes
  FROM (SELECT DISTINCT c FROM t)
), h AS (
  SELECT c, base, xor(list_reduce(bytes, lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)), 4294967295::BIGINT) % {HEAD_MOST} AS h
  FROM b
), f AS (
  SELECT h.c, pos, role, text FROM h JOIN t ON t.c = h.base WHERE pos < h
  UNION ALL SELECT h.c, 1000000 + pos, role, text FROM h JOIN t ON t.c = h.c WHERE pos >= h
), s AS (
  SELECT h.c, coalesce(q, []) AS q FROM h LEFT JOIN (SELECT c, list({{'role': role, 'text': text}} ORDER BY pos) AS q FROM f GROUP BY c) USING (c)
), p AS (
  SELECT c, d, len(q) AS n, q[: d] AS g, CASE WHEN d > 0 THEN q[d].text ELSE '' END AS last FROM (SELECT *, unnest(range(len(q) + 1)) AS d FROM s)
), nodes AS (
  SELECT d, g, min(c) AS m, count(*) AS n, length(any_value(last)) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends, count(*) FILTER (n > d) = 0 AS leaf
  FROM p GROUP BY d, g
), up AS (
  SELECT x.g[: k] AS g, sum((x.n - 1) * x.chars) AS saved, count(*) FILTER (x.leaf) AS leaves, count(*) FILTER (x.d = k + 1) AS children
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM nodes) x GROUP BY 1
)
SELECT a.m::BIGINT AS conv_id, a.d::BIGINT AS depth, b.m::BIGINT AS parent_conv_id, a.n::BIGINT AS n_convs, up.children::BIGINT AS n_children,
       up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN up ON up.g = a.g LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.g = a.g[: a.d - 1]
"""
