"""Operator 11, a Merkle manifest of a dataset: a root over all rows, and for each row a proof that it belongs to it.

A leaf is the hash of a row's fields. The leaves of a group, in order, are numbered; numbers divided by the fanout
give parents, whose children meet in a sorted array that is hashed, level by level until one node is left, the
group's subroot. The subroots in order of their groups are the leaves of one more such tree, with the root. Then, level
by level from the root down, each node's children get what their parent needs besides them, so a leaf
ends up with all siblings up to the root: a level of half as many rows carries one sibling less, and the leaves themselves, the
most rows, are never joined.

Defined results: a null field is hashed as ``-``, which no value is; rows of a null group are a group of their own, before all
others; rows of a null order column come first; rows of equal order are in order of their leaves, and of equal leaves
interchangeable; repeated rows are a leaf each; an empty table gives an empty result; a group of one row has its leaf for
subroot, and a table of one group its subroot for root; other columns of any name are ignored, unless kept. A text is
hashed whole, however long. Digests are kept as 32 bytes and hashed as their lowercase hex text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import ordered_index
from .common import salted_lookup, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a level in a task, at most as many as it takes to have two tasks; levels get smaller, and so their tasks fewer.
PER_TASK = 8192
#: Joins of a plan before what they gave is written.
EVERY = 6
_PROOF = "array<struct<left:binary,right:binary>>"


def digest(x: Column) -> Column:
    """sha256 of a text or of bytes, as bytes."""
    return F.unhex(F.sha2(x.cast("binary"), 256))


def hex_text(x: Column) -> Column:
    """Bytes as lowercase hex text."""
    return F.lower(F.hex(x))


def node_digest(parts: Column) -> Column:
    """Digest of the hex texts of concatenated digests."""
    return digest(hex_text(parts))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of fields, each ``-`` if null, else its count of UTF-8 bytes, ``:`` and itself."""
    said = [c.cast("string") for c in fields.values()]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]))


def _joined(digests: Column) -> Column:
    """The bytes of an array of digests, one after the other."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def numbered(leaves: DataFrame, group: str, order: str, small: int = 50_000) -> DataFrame:
    """``leaves`` (group, order, h) with at (its place in its group, by order and h) and n (the group's rows).

    Range-sorted and numbered over all groups, less where the group begins, so a group with most of the rows lies in many tasks.
    Up to ``small`` groups' beginnings are broadcast, more join salted.
    """
    rows = stage(ordered_index(leaves, F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), F.col("h"), name="_row"), "numbered")
    groups = stage(rows.groupBy(group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n")), "groups")
    if groups.count() <= small:
        found = rows.join(F.broadcast(groups.withColumnRenamed(group, "_of")), F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        found = salted_lookup(rows, groups, group, F.col("_row"))
    return found.withColumn("at", F.col("_row") - F.col("_first")).drop("_row", "_first")


def _level(nodes: DataFrame, fanout: int, tasks: int) -> DataFrame:
    """Parents g, at, n, h, kids of the nodes (g, at, n, h[, own]) of groups with more than one."""
    kid = F.struct(*[c for c in nodes.columns if c in ("at", "h", "own")])
    found = nodes.filter("n > 1").groupBy("g", F.floor(F.col("at") / F.lit(fanout)).alias("at"), F.ceil(F.col("n") / F.lit(fanout)).alias("n")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    return found.withColumn("h", node_digest(_joined(F.col("kids.h")))).select("g", "at", "n", "h", "kids").coalesce(tasks)


def tree_levels(leaves: DataFrame, fanout: int, label: str) -> list[DataFrame]:
    """The leaves (g, at, n, h, own) and, level by level, the parents over them (g, at, n, h, kids); n counts the group's nodes of the level."""
    if fanout < 2:
        raise ValueError("fanout: at least 2")
    size = leaves.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("all")).first()
    levels, most, total = [leaves], size["most"], size["all"]
    while most > 1:
        most, total = -(-most // fanout), -(-total // fanout)
        levels.append(stage(_level(levels[-1], fanout, 2 + total // PER_TASK), label))
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """g, h of the node that remains of each group."""
    return reduce(DataFrame.unionByName, [x.filter("n = 1").select("g", "h") for x in levels])


def siblings_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """own, h, proof of every leaf; ``tops``: g and the proof of each group's last node.

    A proof is an array, level by level upwards, of what stands left and right of the node among its parent's children.
    """
    known = tops.select("g", F.lit(0).cast("long").alias("at"), F.col("proof").cast(_PROOF).alias("proof"))
    open_ = None
    for k, level in reversed(list(enumerate(levels))[1:]):
        ended = level.filter("n = 1").select("g", "at").join(known, ["g", "at"])
        open_ = ended if open_ is None else ended.unionByName(open_.select("g", "at", "proof"))
        if k % EVERY == 0:
            open_ = stage(open_, "proofs")
        rows = level.select("g", "at", "kids").join(open_, ["g", "at"])
        rows = rows.select("g", "proof", "kids", F.posexplode("kids").alias("_i", "_kid"))
        left = _joined(F.slice(F.col("kids.h"), F.lit(1), F.col("_i")))
        right = _joined(F.slice(F.col("kids.h"), F.col("_i") + 2, F.size("kids")))
        proof = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))).cast(_PROOF), F.col("proof"))
        open_ = rows.select("g", "_kid.at", "_kid.h", *(["_kid.own"] if k == 1 else []), proof.alias("proof"))
    alone = levels[0].filter("n = 1").select("g", "at", "h", "own").join(known, ["g", "at"])
    return (alone if open_ is None else alone.unionByName(open_.select(alone.columns))).select("own", "h", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof make."""
    return F.aggregate(proof, leaf, lambda a, s: node_digest(F.concat(s["left"], a, s["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, as they stand."""
    return node_digest(F.aggregate(proof, F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"])))


def manifest(leaves: DataFrame, group: str, order: str, fanout: int = 2) -> tuple[DataFrame, bytes | None]:
    """The rows of ``leaves`` (group, order and h, the leaf's digest, and any others) with subroot and proof, and the root.

    Results are bytes. Columns of ``leaves`` named subroot or proof are replaced.
    """
    kept = [c for c in leaves.columns if c not in ("h", "subroot", "proof")]
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null stands before all others, others keep their order
    own = F.struct(*kept)
    inner = leaves.select(key.alias("_g"), F.col(order).alias("_o"), own.alias("own"), "h")
    inner = stage(numbered(inner, "_g", "_o").select(F.col("_g").alias("g"), "at", "n", "h", "own"), "leaves")
    levels = tree_levels(inner, fanout, "level")
    ends = stage(subroots(levels), "subroots")
    # The tree over the subroots: one group, whose leaves are the groups.
    upper = stage(numbered(ends.select(F.lit("").alias("_all"), F.col("g").alias("_o"), "h"), "_all", "_o"), "upper")
    upper = upper.select(F.lit("").alias("g"), "at", "n", "h", F.struct(F.col("_o").alias("g")).alias("own"))
    above = tree_levels(upper, fanout, "upper_level")
    root = subroots(above).first()
    start = above[-1].filter("n = 1").select("g", F.array().cast(_PROOF).alias("proof"))
    tops = stage(siblings_down(above, start).select("own.g", F.col("h").alias("subroot"), "proof"), "tops")
    found = siblings_down(levels, tops.select("g", "proof"))
    found = found.select(F.coalesce(F.concat(F.lit("="), F.col("own")[group].cast("string")), F.lit("-")).alias("_g"), *[F.col("own")[c].alias(c) for c in kept], "h", "proof")
    # One row a group; a group of any size is spread.
    if tops.count() <= 50_000:
        found = found.join(F.broadcast(tops.select(F.col("g").alias("_g"), "subroot")), "_g")
    else:
        found = salted_lookup(found, tops.select(F.col("g").alias("_g"), "subroot"), "_g", F.col("h"))
    return found.drop("_g"), root["h"] if root else None


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang, h (the leaf) and found (the leaf of the row as it is found: with ``changed`` fields where ``tampered``); one pass over the texts."""
    told = {c: F.col(c) for c in fields}
    leaf = leaf_digest(told)
    found = leaf if tampered is None else F.when(tampered, leaf_digest(told | (changed or {}))).otherwise(leaf)
    return docs.select("doc_id", "lang", leaf.alias("h"), found.alias("found"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof of every document, and whether the rows with a changed n_chars are found out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    # Texts are read once; what goes on is digests.
    leaves = stage(document_leaves(docs, FIELDS, tampered, {"n_chars": F.col("n_chars") + 1}), "digests")
    rows, root = manifest(leaves, "lang", "doc_id", 2)
    root = F.lit(root).cast(T.BinaryType())
    rows = rows.withColumn("again", folded(F.col("found"), F.col("proof")))
    return rows.select(
        "doc_id",
        hex_text(F.col("h")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(root).alias("root"),
        hex_text(proof_digest(F.col("proof"))).alias("proof_sha256"),
        hex_text(F.col("again")).alias("folded_root"),
        (F.col("again") == root).alias("verified"),
    )


# crc32 by its bits; trees by recursion over levels, a doc's place at a level being its place shifted.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 AS bad
  FROM documents),
x AS (
  SELECT doc_id, lang, n_chars, bad, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z
  FROM t),
l AS (
  SELECT doc_id, lang, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || z) AS leaf,
    sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + CAST(bad AS BIGINT) AS VARCHAR)) || ':' || (n_chars + CAST(bad AS BIGINT)) END || z) AS found
  FROM x),
p AS (
  SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
tree AS (
  SELECT 0 AS k, g, i, n, leaf AS h FROM p
  UNION ALL
  SELECT k + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY k, g, i // 2, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
up AS (
  SELECT 0 AS k, i, n, h FROM s
  UNION ALL
  SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, i // 2, n),
r AS (SELECT h AS root FROM up WHERE n = 1),
steps AS (
  SELECT p.g, p.i AS o, tree.k, coalesce(b.h, '') AS h, tree.i % 2 = 1 AS before
  FROM p JOIN tree ON tree.g = p.g AND tree.i = p.i >> tree.k AND tree.n > 1
  LEFT JOIN tree b ON b.g = tree.g AND b.k = tree.k AND b.i = xor(tree.i, 1)
  UNION ALL
  SELECT p.g, p.i, 1000 + up.k, coalesce(b.h, ''), up.i % 2 = 1
  FROM p JOIN s ON s.g = p.g JOIN up ON up.i = s.i >> up.k AND up.n > 1
  LEFT JOIN up b ON b.k = up.k AND b.i = xor(up.i, 1)),
proof AS (
  SELECT g, o, list({'h': h, 'before': before} ORDER BY k) AS s FROM steps GROUP BY g, o),
done AS (
  SELECT p.*, s.h AS subroot, r.root, coalesce(proof.s, []) AS s
  FROM p JOIN s ON s.g = p.g CROSS JOIN r LEFT JOIN proof ON proof.g = p.g AND proof.o = p.i),
fold AS (
  SELECT g, i, 1 AS k, s, found AS h FROM done
  UNION ALL
  SELECT g, i, k + 1, s, sha256(CASE WHEN s[k].before THEN s[k].h || h ELSE h || s[k].h END) FROM fold WHERE k <= len(s))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(done.s, lambda x: x.h), '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM done JOIN fold ON fold.g = done.g AND fold.i = done.i AND fold.k = len(fold.s) + 1
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": ORACLE}
