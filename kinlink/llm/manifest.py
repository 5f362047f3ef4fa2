"""Merkle manifest of a dataset: a tree of digests per source, a tree over the sources, and a proof for every row.

A level of a tree is a table of (tree, position, digest). Its nodes meet by an equijoin on computed sibling positions: XOR
with the slot for binary trees, slot offsets otherwise. The node of slot zero asks for its whole run, which holds the
siblings of every node in it, and emits the parent. Proofs go down again: a run's row joins the run of its parent and adds
it to the path, so a path is shuffled once a run and not once a row.

Positions are those of a range-partitioned, sorted, written table: rows before a partition, counted a partition, plus the
place in it. No window orders the rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import attach_small
from kinlink.session import cut

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_input(values: list[Column]) -> Column:
    """The values one after the other: ``-`` for null, else the UTF-8 length, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes; digests travel as bytes and are spelt as hex text only where they are hashed."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def spelt(value: Column) -> Column:
    return F.lower(F.hex(value))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` written in the order of (tree, ``order``), with ``idx``, the position in the tree, and ``n``, its rows."""
    keys = [tree, *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    held = cut(placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held")), f"{name}-parts")
    # One row a tree and partition it lies in: a window over a tree's partitions is short however many rows it has.
    whole = Window.partitionBy(tree)
    before = F.sum("_held").over(whole.orderBy("_part")) - F.col("_held")
    held = held.select(tree, "_part", "_first", before.alias("_before"), F.sum("_held").over(whole).alias("n"))
    found = attach_small(placed, cut(held, f"{name}-starts"), [tree, "_part"])
    return found.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def sibling_runs(nodes: DataFrame, arity: int) -> DataFrame:
    """``tree, n, run, siblings, digest`` of the next level: each run's digests in order, as bytes, and their parent.

    Slot-zero nodes compute the positions of their run and meet those nodes by an equijoin; unique keys, no hot group.
    """
    zero = nodes.where(f"idx % {arity} = 0").select("tree", "n", "idx", F.explode(F.expr(f"sequence(0L, least({arity}L, n - idx) - 1)")).alias("slot"))
    sibling = F.col("idx").bitwiseXOR(F.col("slot")) if arity == 2 else F.col("idx") + F.col("slot")
    asked = zero.select("tree", "n", F.expr(f"idx div {arity}").alias("run"), "slot", sibling.alias("sibling"))
    met = asked.join(nodes.select("tree", F.col("idx").alias("sibling"), "digest"), ["tree", "sibling"])
    held = met.groupBy("tree", "n", "run").agg(F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("held"))
    spelled = F.array_join(F.transform("held", lambda x: spelt(x["digest"])), "")
    text = held.select("tree", F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), "run", spelled.alias("text"))
    return text.select("tree", "n", "run", F.unhex("text").alias("siblings"), digest(F.col("text")).alias("digest"))


def build_trees(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written runs of each level of every tree, lowest first, and ``tree, digest`` of the roots.

    ``nodes`` has ``tree, idx, n, digest``. The number of levels follows the largest tree, one number on the driver.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.where("n = 1").select("tree", "digest")
    while largest > 1:
        runs = cut(sibling_runs(nodes.where("n > 1"), arity), f"{name}-level{len(levels)}")
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("idx"), "n", "digest")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
        largest = -(-largest // arity)
    return levels, cut(roots, f"{name}-roots")


def run_paths(levels: list[DataFrame], trees: DataFrame, arity: int, name: str) -> DataFrame:
    """``tree, run, siblings, above`` and the other columns of ``trees`` for each lowest run.

    ``above`` lists slot and run of each level over the run's parent, then what ``trees`` (one row a tree) has in
    ``above``. Trees of a single node have one row with null ``siblings``.
    """
    carried = [c for c in trees.columns if c not in ("tree", "above")]
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        runs = levels[k].select("tree", "n", "run", "siblings")
        found = runs.where("n = 1").join(trees, "tree").drop("n")
        if paths is not None:
            up = paths.select("tree", F.col("run").alias("_up"), F.col("siblings").alias("_run"), "above", *carried)
            lower = runs.where("n > 1").withColumn("_up", F.expr(f"run div {arity}")).join(up, ["tree", "_up"])
            step = F.struct((F.col("run") % arity).cast("int").alias("slot"), F.col("_run").alias("run"))
            lower = lower.withColumn("above", F.concat(F.array(step), "above"))
            found = found.unionByName(lower.select(*found.columns))
        paths = cut(found, f"{name}-paths{k}")
    single = trees if paths is None else trees.join(paths.select("tree").distinct(), "tree", "left_anti")
    single = single.select("tree", F.lit(0).cast("long").alias("run"), F.lit(None).cast("binary").alias("siblings"), "above", *carried)
    return single if paths is None else paths.select(*single.columns).unionByName(single)


def merkle_manifest(docs: DataFrame, columns: list[str] | None = None, arity: int = 16, tampered: Column | None = None) -> DataFrame:
    """``doc_id, source, idx, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf is the digest of ``columns``; leaves of a source ascend by id. ``tampered`` is true for rows whose proof is
    checked with the capitals A-Z of the text in lower case; all other rows are checked with their own leaf.
    ``verified`` says whether the leaf folds to the root with the untampered siblings.

    Defined results: null sources form one tree, ordered first; null ids come first in a tree and are not tampered by a test
    on the id that is null; rows that repeat an id are ordered by leaf, and equal rows have equal leaves; a source of one
    row has its leaf as subroot; a table of one row has it as root, and its proof is the digest of nothing; an empty table
    gives no rows; a null text stays null when tampered; other columns are not read.
    """
    columns = columns or LEAF_COLUMNS
    changed = F.coalesce(tampered if tampered is not None else F.lit(False), F.lit(False))
    lowered = F.translate("text", CAPITALS, CAPITALS.lower())
    other = [lowered if c == "text" else F.col(c) for c in columns]
    # The first sign keeps the null source apart from all names, and first in their order.
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree")
    leaves = docs.select(
        "doc_id", tree, digest(leaf_input([F.col(c) for c in columns])).alias("digest"),
        F.when(changed, digest(leaf_input(other))).alias("tampered"), F.monotonically_increasing_id().alias("row"),
    )
    # The row number splits equal rows over range partitions; their order among themselves changes nothing.
    rows = cut(numbered(cut(leaves, "leaves"), "tree", ["doc_id", "digest", "row"], "leaf-order"), "numbered-leaves")
    levels, subroots = build_trees(rows.select("tree", "idx", "n", "digest"), arity, "source")

    whole = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    whole = cut(numbered(whole, "tree", ["source"], "source-order"), "numbered-sources")
    top, root = build_trees(whole, arity, "whole")
    base = root.select("tree", F.col("digest").alias("root"), F.expr("CAST(array() AS ARRAY<STRUCT<slot: INT, run: BINARY>>)").alias("above"))
    upper = run_paths(top, base, arity, "whole").withColumnRenamed("tree", "_whole").withColumnRenamed("run", "_run")
    at = whole.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "idx", F.col("tree").alias("_whole"), F.expr(f"idx div {arity}").alias("_run"))
    step = F.struct((F.col("idx") % arity).cast("int").alias("slot"), F.col("siblings").alias("run"))
    above = F.when(F.col("siblings").isNotNull(), F.concat(F.array(step), "above")).otherwise(F.col("above"))
    trees = cut(at.join(upper, ["_whole", "_run"]).select("tree", above.alias("above"), "subroot", "root"), "tree-paths")

    paths = run_paths(levels, trees, arity, "source")
    met = rows.withColumn("run", F.expr(f"idx div {arity}")).join(paths, ["tree", "run"])
    own = F.struct((F.col("idx") % arity).cast("int").alias("slot"), F.col("siblings").alias("run"))
    steps = F.when(F.col("siblings").isNotNull(), F.concat(F.array(own), "above")).otherwise(F.col("above"))
    sides = F.transform(steps, lambda s: F.struct(
        F.substring(spelt(s["run"]), F.lit(1), 64 * s["slot"]).alias("left"),
        F.substring(spelt(s["run"]), 64 * s["slot"] + 65, F.lit(64 * arity)).alias("right"),
    ))
    met = met.select(
        "doc_id", F.expr("IF(tree = '', NULL, substring(tree, 2))").alias("source"), "idx", spelt(F.col("digest")).alias("leaf"),
        spelt(F.col("subroot")).alias("subroot"), spelt(F.col("root")).alias("root"),
        spelt(F.coalesce("tampered", "digest")).alias("given"), sides.alias("sides"),
    )
    proof = F.sha2(F.array_join(F.transform("sides", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    fold = F.aggregate("sides", F.col("given"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))
    shown = met.select("doc_id", "source", "idx", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_fifth(doc_id: Column) -> Column:
    """Whether 5 divides the unsigned CRC-32 of the id in decimal."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def manifest_sql(arity: int = 16, depth: int = 7) -> str:
    """The same rows in SQL for trees of at most ``arity ** depth`` nodes: levels one after the other, then the proofs."""
    h = lambda text: f"sha256({text})"
    shown = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v})) || ':' || ({v}) END"
    capitals = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    leaf = " || ".join(shown(c, c if c in ("source", "lang", "text") else f"CAST({c} AS VARCHAR)") for c in LEAF_COLUMNS)
    changed = leaf.replace(shown("text", "text"), shown("text", capitals))
    crc = (
        "xor(4294967295::BIGINT, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda acc, b: "
        "list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT), xor(acc, b)), 4294967295::BIGINT))"
    )
    ctes = [f"""leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM (
SELECT doc_id, source, {h(leaf)} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {h(changed)} ELSE {h(leaf)} END AS given FROM documents))"""]

    def levels(tag: str, first: str) -> None:
        ctes.append(f"{tag}0 AS MATERIALIZED ({first})")
        for k in range(depth):
            ctes.append(f"""{tag}r{k} AS MATERIALIZED (SELECT source, n, idx // {arity} AS run, string_agg(digest, '' ORDER BY idx) AS text FROM {tag}{k} WHERE n > 1 GROUP BY ALL)""")
            ctes.append(f"{tag}{k + 1} AS MATERIALIZED (SELECT source, run AS idx, (n + {arity - 1}) // {arity} AS n, {h('text')} AS digest FROM {tag}r{k})")
        ctes.append(f"{tag}_root AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT source, digest FROM {tag}{k} WHERE n = 1" for k in range(depth + 1)) + ")")

    levels("s", "SELECT source, idx, n, leaf AS digest FROM leaves")
    levels("w", "SELECT 'all' AS source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, digest FROM s_root")
    ctes.append("sources AS MATERIALIZED (SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM s_root)")
    ctes.append("p0 AS MATERIALIZED (SELECT doc_id, l.source, leaf, idx, subroot, place, '' AS proof, given AS folded FROM leaves l JOIN sources t ON l.source IS NOT DISTINCT FROM t.source)")
    step = 0
    for tag, place, tree in (("s", "idx", "p.source IS NOT DISTINCT FROM r.source"), ("w", "place", "true")):
        for k in range(depth):
            slot = f"64 * (({place} // {arity**k}) % {arity})::INT"
            left, right = f"substr(r.text, 1, {slot})", f"substr(r.text, {slot} + 65)"
            ctes.append(f"""p{step + 1} AS MATERIALIZED (SELECT doc_id, p.source, leaf, idx, subroot, place,
  CASE WHEN r.text IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN r.text IS NULL THEN folded ELSE {h(f'{left} || folded || {right}')} END AS folded
  FROM p{step} p LEFT JOIN {tag}r{k} r ON {tree} AND r.run = {place} // {arity ** (k + 1)})""")
            step += 1
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, w_root.digest AS root, {h('proof')} AS proof_sha256, folded AS folded_root, folded = w_root.digest AS verified FROM p{step}, w_root"""
